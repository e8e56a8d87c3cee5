"""Registered queries: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeledger.operators.profile import attach_stats, profile, profile_all, samples_all
from lakeledger.plans.driver_schema import DRIVER_COLUMNS
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.q_scan import _q, q_scan_columns
from lakeledger.plans.registry import register
from lakeledger.sources.tables import CATALOGUE_NAMES, driver_sources, read_table

_OUT = "table_name, column_name, ordinal_position, row_count, null_count, null_percentage, distinct_count"


def _profile_sql(table_label: str, from_sql: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols, start=1):
        qc = f'"{c}"'
        parts.append(f"""
SELECT {_q(table_label)} AS table_name, {_q(c)} AS column_name, CAST({i} AS INTEGER) AS ordinal_position,
       CAST(count(*) AS BIGINT) AS row_count,
       CASE WHEN count(*) > 0 THEN CAST(count(*) - count({qc}) AS BIGINT) END AS null_count,
       CASE WHEN count(*) > 0 THEN round_even(CAST(count(*) - count({qc}) AS DOUBLE) / count(*) * 100, 2) END AS null_percentage,
       CASE WHEN count(*) > 0 THEN CAST(count(DISTINCT {qc}) AS BIGINT) END AS distinct_count
FROM {from_sql}""")
    return "\nUNION ALL".join(parts)


def _cols(t: str) -> list[str]:
    return [c for c, _ in DRIVER_COLUMNS[t]]


def _proj(df):
    return df.select(*_OUT.split(", "))


@register("profile_lineitem", _profile_sql("brz_lineitem", "lineitem", _cols("lineitem")))
def q_profile_lineitem(spark, sf_dir):
    return _proj(profile(read_table(spark, sf_dir, "lineitem"), "brz_lineitem"))


@register("profile_all", "\nUNION ALL".join(
    _profile_sql(CATALOGUE_NAMES[t], t, _cols(t)) for t in DRIVER_COLUMNS))
def q_profile_all(spark, sf_dir):
    return _proj(profile_all(spark, driver_sources(spark, sf_dir)))


_NULLS_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate", "all_null"]


@register("profile_nulls", with_fx(["fx_lineitem_nulls"], _profile_sql("fx_lineitem_nulls", "fx_lineitem_nulls", _NULLS_COLS)))
def q_profile_nulls(spark, sf_dir):
    return _proj(profile(Fixtures(spark, sf_dir).fx_lineitem_nulls, "fx_lineitem_nulls"))


@register("profile_empty", with_fx(["fx_empty"], _profile_sql("fx_empty", "fx_empty", ["o_orderkey", "o_orderstatus"])))
def q_profile_empty(spark, sf_dir):
    return _proj(profile(Fixtures(spark, sf_dir).fx_empty, "fx_empty"))


# No oracle: approximate by design.  Our tests bound its error.
@register("profile_approx")
def q_profile_approx(spark, sf_dir):
    return _proj(profile(read_table(spark, sf_dir, "lineitem"), "brz_lineitem", mode="approx", rsd=0.02))


# -- samples: all columns of three tables ----------------------------------------
def _sample_sources(spark, sf_dir):
    return {CATALOGUE_NAMES[t]: read_table(spark, sf_dir, t) for t in ("documents", "orders", "events")}


def _samples_sql() -> str:
    parts = []
    for t in ("documents", "orders", "events"):
        for c in _cols(t):
            parts.append(f"""
SELECT {_q(CATALOGUE_NAMES[t])} AS table_name, {_q(c)} AS column_name,
       CASE WHEN regexp_matches(s, '^\\s*$') THEN NULL ELSE s END AS sample_values
FROM (SELECT string_agg(h, ' | ' ORDER BY h) AS s
      FROM (SELECT DISTINCT substring(CAST("{c}" AS VARCHAR), 1, 200) AS h FROM {t}
            WHERE "{c}" IS NOT NULL ORDER BY h LIMIT 5))""")
    return "\nUNION ALL".join(parts)


@register("samples", _samples_sql())
def q_samples(spark, sf_dir):
    return samples_all(_sample_sources(spark, sf_dir))


def _profile_samples_sql(label: str, src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols, start=1):
        parts.append(f"""
SELECT {_q(label)} AS table_name, {_q(c)} AS column_name, CAST({i} AS INTEGER) AS ordinal_position,
       CAST(count(*) AS BIGINT) AS row_count,
       CASE WHEN count(*) > 0 THEN CAST(count(*) - count("{c}") AS BIGINT) END AS null_count,
       CASE WHEN count(*) > 0 THEN round_even(CAST(count(*) - count("{c}") AS DOUBLE) / count(*) * 100, 2) END AS null_percentage,
       CASE WHEN count(*) > 0 THEN CAST(count(DISTINCT "{c}") AS BIGINT) END AS distinct_count,
       (SELECT CASE WHEN regexp_matches(s, '^\\s*$') THEN NULL ELSE s END
        FROM (SELECT string_agg(h, ' | ' ORDER BY h) AS s
              FROM (SELECT DISTINCT substring(CAST("{c}" AS VARCHAR), 1, 200) AS h FROM {src}
                    WHERE "{c}" IS NOT NULL ORDER BY h LIMIT 5))) AS sample_values
FROM {src}""")
    return "\nUNION ALL".join(parts)


# -- attach_stats: scanned column rows + computed statistics -------------------
def _attach_sql() -> str:
    from lakeledger.plans.q_scan import _SCAN_COLUMNS_SQL
    prof = "\nUNION ALL".join(_profile_samples_sql(CATALOGUE_NAMES[t], t, _cols(t)) for t in DRIVER_COLUMNS)
    return f"""
WITH sc AS ({_SCAN_COLUMNS_SQL}), pr AS ({prof})
SELECT sc.table_name, sc.column_name, sc.data_type, sc.ordinal_position, sc.is_nullable, sc.is_primary_key,
       coalesce(pr.null_percentage, sc.null_percentage) AS null_percentage,
       coalesce(pr.distinct_count, sc.distinct_count) AS distinct_count,
       CASE WHEN sc.data_type <> 'array<float>' THEN coalesce(pr.sample_values, sc.sample_values) END AS sample_values,
       sc.scanned_at
FROM sc LEFT JOIN pr ON sc.table_name = pr.table_name AND sc.column_name = pr.column_name"""


@register("attach_stats", _attach_sql())
def q_attach_stats(spark, sf_dir):
    stats = profile_all(spark, driver_sources(spark, sf_dir), with_samples=True)
    out = attach_stats(q_scan_columns(spark, sf_dir), stats)
    # the engines write small floats inside arrays differently (2.0E-4, 0.0002)
    return out.withColumn("sample_values", F.when(F.col("data_type") != "array<float>", F.col("sample_values")))


# -- digest mode: long texts keyed by SHA-256; counts equal the exact ones ------
@register("profile_digest", "\nUNION ALL".join(_profile_sql(CATALOGUE_NAMES[t], t, _cols(t)) for t in DRIVER_COLUMNS))
def q_profile_digest(spark, sf_dir):
    return _proj(profile_all(spark, driver_sources(spark, sf_dir), mode="digest"))


# -- profile_catalogue: statistics and samples of the stored catalogue rows -----
# (fx_tables mixes NULL, '' and values, so null shares and samples are real;
# its columns are text and integers, which print alike on both engines)
_CAT_COLS = ["table_name", "layer", "row_count", "column_count", "description", "business_owner",
             "source_system", "refresh_frequency", "tags", "scanned_at", "updated_at", "updated_by"]


@register("profile_catalogue", with_fx(["fx_tables"], _profile_samples_sql("fx_tables", "fx_tables", _CAT_COLS)))
def q_profile_catalogue(spark, sf_dir):
    p = profile_all(spark, {"fx_tables": Fixtures(spark, sf_dir).fx_tables}, with_samples=True)
    return p.select(*_OUT.split(", "), "sample_values")
