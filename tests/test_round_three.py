"""Bisection of failing sources, mergeable sketches, fitting with rejects, guards, exports read back."""

import pytest
from pyspark.sql import functions as F

from lakeledger import catalogue
from lakeledger.operators.profile import attach_stats, profile
from lakeledger.operators.reconcile import preserve, upsert_fitted
from lakeledger.operators.report import export_nested, read_export, write_export
from lakeledger.operators.sketches import SKETCH_SCHEMA, column_sketches, drop_parts, relative_error, replace_parts, sketch_all, sketch_profile
from lakeledger.operators.suggest import fill_from, prefer
from lakeledger.plans.fixtures import Fixtures
from lakeledger.sources import store
from lakeledger.sources.scan import error_class, isolate, scan
from lakeledger.sources.schema import COLUMNS_SCHEMA, TABLES_SCHEMA, align_to, fit
from lakeledger.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.test_plans import _plan


# -- failing sources -------------------------------------------------------------
@pytest.mark.parametrize("broken", [[], [0], [999], [3, 4], [0, 500, 999], list(range(0, 1000, 125))])
def test_isolate_costs_k_log_n_calls(broken):
    calls = []

    def run(group):
        calls.append(len(group))
        if any(g in broken for g in group):
            raise ValueError(f"bad {[g for g in group if g in broken]}")
        return group
    done, failed = isolate(list(range(1000)), run)
    assert sorted(done) == [i for i in range(1000) if i not in broken]
    assert [n for n, _ in failed] == broken and all(str(e) == f"bad {[n]}" for n, e in failed)
    assert len(calls) <= 1 + 2 * 10 * len(broken)


def test_isolate_edges():
    def fails(group):
        raise KeyError(group[0])
    assert isolate([], fails) == ([], [])
    assert [n for n, _ in isolate(["a"], fails)[1]] == ["a"]
    assert [n for n, _ in isolate(list("abcde"), fails)[1]] == list("abcde")


def test_scan_finds_sources_that_break_while_counting(spark):
    good = {f"ref_{i:02d}": spark.range(i).toDF("x") for i in range(12)}
    bad = {f"ref_{i:02d}x": spark.range(3).filter(F.raise_error(F.lit(f"broken {i}")).cast("boolean")) for i in (2, 7)}
    res = scan(spark, {**good, **bad}, "2024-01-01T00:00:00")
    assert {r.table_name: r.row_count for r in res.tables.collect()} == {n: int(n[4:6]) for n in good}
    errors = {r.table_name: (r.error_class, r.error) for r in res.errors.collect()}
    assert set(errors) == set(bad) and all(c == "USER_RAISED_EXCEPTION" for c, _ in errors.values())
    assert "broken 2" in errors["ref_02x"][1] and "broken 7" in errors["ref_07x"][1]
    assert {r.table_name for r in res.columns.select("table_name").distinct().collect()} == set(good)


def test_error_class():
    assert error_class(ValueError("x")) == "ValueError"
    assert error_class(RuntimeError("Job aborted: [DIVIDE_BY_ZERO] x")) == "DIVIDE_BY_ZERO"


# -- sketches ---------------------------------------------------------------------
def by_column(df, *cols):
    return {r.column_name: tuple(r[c] for c in cols) for r in df.collect()}


def test_sketches_of_parts_merge_to_the_whole(spark):
    li = Fixtures(spark, SF_SMALL).fx_lineitem_nulls
    exact = by_column(profile(li, "t"), "row_count", "null_count", "null_percentage", "distinct_count")
    for part in (None, "all", F.col("l_returnflag"), F.pmod("l_orderkey", F.lit(7))):
        got = by_column(sketch_profile(column_sketches(li, "t", part)), "row_count", "null_count", "null_percentage", "distinct_count")
        assert set(got) == set(exact)
        for c, (rows, nulls, share, distinct) in exact.items():
            assert got[c][:3] == (rows, nulls, share)
            assert abs(got[c][3] - distinct) <= 3 * relative_error() * distinct


def test_a_part_summed_up_again_replaces_its_old_sketch(spark):
    old = column_sketches(spark.range(1000).toDF("x"), "t", "p1").unionByName(column_sketches(spark.range(5000, 5010).toDF("x"), "t", "p2"))
    new = column_sketches(spark.range(10).toDF("x"), "t", "p1")
    kept = replace_parts(old, new)
    assert by_column(sketch_profile(kept), "row_count", "distinct_count") == {"x": (20, 20)}
    assert by_column(sketch_profile(replace_parts(kept, new)), "row_count", "distinct_count") == {"x": (20, 20)}
    gone = spark.createDataFrame([("t", "p2")], "table_name string, part string")
    assert by_column(sketch_profile(drop_parts(kept, gone)), "row_count", "distinct_count") == {"x": (10, 10)}
    assert by_column(sketch_profile(replace_parts(spark.createDataFrame([], SKETCH_SCHEMA), new)), "distinct_count") == {"x": (10,)}


def test_sketches_see_equal_values_as_the_profile_does(spark):
    df = spark.sql("""SELECT * FROM VALUES (0.0D, array(1.0D), 'a', 1Y, true, named_struct('a', 1), date'2024-01-01', X'00', 1.0BD),
        (-0.0D, array(1.0D), 'A', 1Y, false, named_struct('a', cast(null as int)), date'2024-01-01', X'01', 1.00BD),
        (double('NaN'), array(-0.0D), '', 2Y, null, null, null, null, null), (double('NaN'), array(0.0D), null, null, null, null, null, null, null)
        AS v(d, `a'r`, t, b, f, s, day, bin, `dec`)""")
    exact = by_column(profile(df, "t"), "row_count", "null_count", "distinct_count")
    assert by_column(sketch_profile(column_sketches(df, "t")), "row_count", "null_count", "distinct_count") == exact
    empty = sketch_profile(column_sketches(df.where("false"), "t")).collect()
    assert len(empty) == 9 and all((r.row_count, r.null_count, r.distinct_count) == (0, None, None) for r in empty)


def test_sketches_need_no_wide_shuffle(spark):
    plan = _plan(sketch_all({"li": read_table(spark, SF_SMALL, "lineitem")}, {"li": F.col("l_returnflag")}))
    assert plan.count("Exchange hashpartitioning") <= 1 and "ArrowEval" not in plan


def test_refresh_sketches_commits_with_the_estimates(spark, tmp_path):
    root, li = str(tmp_path), read_table(spark, SF_SMALL, "lineitem")
    catalogue.refresh(spark, {"brz_lineitem": li}, root, "2024-01-01T00:00:00")
    one = catalogue.refresh_sketches(spark, {"brz_lineitem": li.filter("l_returnflag = 'R'")}, root, {"brz_lineitem": F.col("l_returnflag")})
    two = catalogue.refresh_sketches(spark, {"brz_lineitem": li.filter("l_returnflag <> 'R'")}, root, {"brz_lineitem": F.col("l_returnflag")})
    assert two == one + 1
    row = store.load_columns(spark, root).filter("column_name = 'l_returnflag'").first()
    assert (row.distinct_count, row.null_percentage) == (3, 0.0)


# -- fitting ------------------------------------------------------------------------
TARGET = "id long, Name string, size int, flag boolean"


def test_fit_sets_rows_aside(spark):
    target = spark.createDataFrame([], TARGET).schema
    src = spark.createDataFrame([("1", "a", "5", "x"), ("2", None, "many", "x"), (None, "c", "7", "x"), ("zz", "d", "9999999999", "x"), ("5", "e", None, "x")],
                                "ID string, name string, SIZE string, other string")
    fitted, rejects = fit(src, target, ["id"])
    assert fitted.columns == target.fieldNames() and [f.dataType for f in fitted.schema] == [f.dataType for f in target]
    assert sorted(map(tuple, fitted.collect())) == [(1, "a", 5, None), (5, "e", None, None)]
    assert sorted(map(tuple, rejects.collect()), key=str) == sorted(
        [("2", "size", "many", "int"), (None, "id", None, "bigint"), ("zz", "id", "zz", "bigint"), ("zz", "size", "9999999999", "int")], key=str)
    with pytest.raises(ValueError):
        fit(src.drop("ID"), target, ["id"])
    assert [x.count() for x in fit(src.where("false"), target, ["id"])] == [0, 0]
    with pytest.raises(Exception):
        align_to(src, target).collect()


def test_fit_prefers_the_same_case(spark):
    target = spark.createDataFrame([], "a int").schema
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        both = spark.createDataFrame([(1, 2)], "A int, a int")
        assert fit(both, target, [])[0].first().a == 2 and align_to(both, target).first().a == 2
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_upsert_fitted_changes_nothing_for_a_reject(spark):
    target = spark.createDataFrame([(1, "old", 1, True), (2, "old", 2, True)], TARGET)
    src = spark.createDataFrame([("1", "new", "x"), ("2", "new", "3"), ("4", "new", "4")], "id string, name string, size string")
    result, rejects = upsert_fitted(target, src, ["id"])
    assert sorted(map(tuple, result.collect())) == [(1, "old", 1, True), (2, "new", 3, None), (4, "new", 4, None)]
    assert [tuple(r) for r in rejects.collect()] == [("1", "size", "x", "int")]


# -- repeated keys on the right ---------------------------------------------------------
def test_a_repeated_key_on_the_right_fails_the_job(spark):
    left = spark.createDataFrame([("t", "c", None)], "table_name string, column_name string, description string")
    right = spark.createDataFrame([("t", "c", "x"), ("t", "c", "y")], left.schema)
    stats = right.selectExpr("table_name", "column_name", "1.0D null_percentage", "1L distinct_count", "description sample_values")
    full = left.selectExpr("*", "cast(null as double) null_percentage", "cast(null as bigint) distinct_count", "cast(null as string) sample_values")
    keys = ["table_name", "column_name"]
    for df in (preserve(left, right, keys, ["description"]), fill_from(left, right, keys, ["description"]),
               prefer(left, right, keys, ["description"]), attach_stats(full, stats)):
        with pytest.raises(Exception, match="duplicate key"):
            df.collect()
    one = right.limit(1)
    assert preserve(left, one, keys, ["description"]).count() == 1 and prefer(left, one, keys, ["description"]).first().description == "x"


# -- exports, reads ------------------------------------------------------------------------
def test_export_reads_back_equal(spark, tmp_path):
    fx = Fixtures(spark, SF_SMALL)
    write_export(export_nested(fx.fx_tables, fx.fx_columns), str(tmp_path / "e"))
    docs = read_export(spark, str(tmp_path / "e"), TABLES_SCHEMA, COLUMNS_SCHEMA)
    assert docs.drop("columns").exceptAll(fx.fx_tables).isEmpty() and docs.count() == fx.fx_tables.count()
    assert docs.where("columns is null").isEmpty()  # a table without columns has an empty array
    back = docs.select(F.inline("columns"))
    known = fx.fx_columns.join(fx.fx_tables.select("table_name"), "table_name", "left_semi").select(back.columns)
    assert back.exceptAll(known).isEmpty() and known.exceptAll(back).isEmpty()
    assert docs.where("size(columns) > 1").select(F.expr("exists(columns, c -> c.ordinal_position < columns[0].ordinal_position)").alias("x")).where("x").isEmpty()
    spark.createDataFrame([("{\"table_name\": ",)], "value string").write.mode("append").text(str(tmp_path / "e"))
    with pytest.raises(Exception):
        read_export(spark, str(tmp_path / "e"), TABLES_SCHEMA, COLUMNS_SCHEMA).collect()


def test_loads_prune_folders_and_push_keys(spark, tmp_path):
    fx = Fixtures(spark, SF_SMALL)
    root = str(tmp_path)
    store.transact(spark, root, lambda read: {store.TABLES: fx.fx_tables, store.COLUMNS: fx.fx_columns})
    plan = _plan(store.load_tables(spark, root, ["gld", "slv"]))
    assert "PartitionFilters: [" in plan and "layer" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(table_name,brz_t9)" in _plan(store.load_columns(spark, root, "brz_t9"))


def test_probe_tells_a_missing_path_from_other_failures(spark, tmp_path, monkeypatch):
    (tmp_path / "x.parquet").write_bytes(b"not parquet at all")
    (tmp_path / "empty").mkdir()
    assert [store.probe(spark, str(tmp_path / p)) for p in ("none", "x.parquet", "empty")] == [False] * 3

    class Denied:
        read = property(lambda self: (_ for _ in ()).throw(PermissionError("denied")))
    with pytest.raises(PermissionError):
        store.probe(Denied(), "anything")
