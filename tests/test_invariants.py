"""Invariants over data-sized fixtures (sf0.001) and property tests."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeledger.operators.edits import apply_edits, diff_rows, overlay
from lakeledger.operators.profile import profile, profile_all
from lakeledger.operators.reconcile import (
    delete_stale, preserve_tables, stale_tables, upsert,
)
from lakeledger.plans.fixtures import Fixtures
from lakeledger.sources.scan import live_tables
from lakeledger.sources.schema import TABLE_KEYS, TABLE_USER_FIELDS
from lakeledger.sources.tables import driver_sources, read_table
from tests.conftest import SF_SMALL, SF_MID


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_twice_equals_once(spark):
    fx = Fixtures(spark, SF_SMALL)
    src = preserve_tables(fx.fx_scan_tables, fx.fx_tables)
    once = upsert(fx.fx_tables, src, TABLE_KEYS)
    twice = upsert(once, src, TABLE_KEYS)
    assert _rows(once) == _rows(twice)


def test_preserve_never_loses_a_nonempty_user_field(spark):
    fx = Fixtures(spark, SF_SMALL)
    kept = preserve_tables(fx.fx_scan_tables, fx.fx_tables)
    j = fx.fx_tables.alias("o").join(kept.alias("n"), "table_name")
    lost = j.filter(" OR ".join(f"(o.{f} IS NOT NULL AND o.{f} <> '' AND n.{f} IS NULL)"
                                for f in TABLE_USER_FIELDS))
    assert lost.count() == 0


def test_overlay_and_apply_agree_on_user_fields(spark):
    fx = Fixtures(spark, SF_SMALL)
    ov = overlay(fx.fx_tables, fx.fx_edits, TABLE_KEYS).select("table_name", *TABLE_USER_FIELDS)
    ap = apply_edits(fx.fx_tables, fx.fx_edits, TABLE_KEYS, "now").select("table_name", *TABLE_USER_FIELDS)
    assert _rows(ov) == _rows(ap)


def test_stale_and_kept_partition_the_store(spark):
    fx = Fixtures(spark, SF_SMALL)
    live = live_tables(fx.fx_live_tables)
    stale = stale_tables(fx.fx_tables, live)
    kept, _ = delete_stale(fx.fx_tables, fx.fx_columns, live)
    s = {r[0] for r in stale.collect()}
    k = {r[0] for r in kept.select("table_name").collect()}
    allt = {r[0] for r in fx.fx_tables.select("table_name").collect()}
    assert s.isdisjoint(k) and s | k == allt


def test_distinct_bounded_by_non_null_rows(spark):
    p = profile_all(spark, driver_sources(spark, SF_SMALL))
    bad = p.filter(F.col("distinct_count") > F.col("row_count") - F.col("null_count"))
    assert bad.count() == 0


def test_diff_of_a_frame_with_itself_is_empty(spark):
    c = Fixtures(spark, SF_SMALL).fx_columns
    assert diff_rows(c, c, ["table_name", "column_name"], ["description", "business_name"],
                     ["is_primary_key"]).count() == 0


def test_approx_profile_within_error_bound(spark):
    li = read_table(spark, SF_MID, "lineitem")
    exact = {r.column_name: r.distinct_count for r in profile(li).collect()}
    approx = {r.column_name: r.distinct_count for r in profile(li, mode="approx", rsd=0.02).collect()}
    for c, e in exact.items():
        assert abs(approx[c] - e) <= max(2, 0.08 * e), (c, e, approx[c])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=0, max_size=30),
       st.lists(st.one_of(st.none(), st.text("ab ", max_size=3)), min_size=0, max_size=30))
def test_profile_matches_python(spark, ints, texts):
    n = max(len(ints), len(texts))
    ints = ints + [None] * (n - len(ints))
    texts = texts + [None] * (n - len(texts))
    df = spark.createDataFrame(list(zip(ints, texts)), "i int, s string")
    got = {r.column_name: r for r in profile(df, with_samples=True).collect()}
    for name, vals in (("i", ints), ("s", texts)):
        r = got[name]
        nn = [v for v in vals if v is not None]
        assert r.row_count == n
        if n == 0:
            assert r.distinct_count is None and r.null_percentage is None
            continue
        assert r.null_count == n - len(nn)
        assert r.distinct_count == len(set(nn))
        heads = sorted({str(v) for v in nn})[:5]
        joined = " | ".join(heads)
        want = joined if joined.strip(" ") else None
        assert r.sample_values == want


def test_digest_mode_equals_exact_including_samples(spark):
    from lakeledger.sources.tables import CATALOGUE_NAMES
    srcs = {CATALOGUE_NAMES[t]: read_table(spark, SF_SMALL, t) for t in ("documents", "pages", "orders")}
    exact = _rows(profile_all(spark, srcs, with_samples=True))
    digest = _rows(profile_all(spark, srcs, mode="digest", with_samples=True, digest_over=16))
    assert exact == digest


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.5, -2.25, float("nan"), float("inf")])),
                min_size=1, max_size=25))
def test_double_distinct_follows_sql_equality(spark, vals):
    import math
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile(df, with_samples=True).first()
    norm = {("nan" if math.isnan(v) else (0.0 if v == 0 else v)) for v in vals if v is not None}
    assert r.null_count == sum(v is None for v in vals)
    assert r.distinct_count == len(norm)
    approx = profile(df, mode="approx").first()
    assert approx.distinct_count == len(norm)
