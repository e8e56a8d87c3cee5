"""Lost-update, strictness and isolation cases."""

import pytest

from pyspark.sql import functions as F

from lakeledger.operators.edits import append_edits, apply_edits, bad_edits, consume_edits
from lakeledger.operators.profile import profile
from lakeledger.operators.report import search_tables
from lakeledger.operators.suggest import explode_replies, parse_replies
from lakeledger.sources import store
from lakeledger.sources.scan import scan

EDIT = "table_name string, field string, value string, edited_at string"


def test_an_unreadable_edit_log_is_not_an_empty_one(spark, tmp_path):
    log = str(tmp_path / "log")
    edits = spark.createDataFrame([("t", "tags", "x", "2024-01-01")], EDIT)
    assert append_edits(log, edits) == 0
    (tmp_path / "log" / "part-bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        append_edits(log, edits)


def test_consume_drops_exactly_the_applied_edits(spark):
    schema = "table_name string, column_name string, field string, value string, edited_at string, seq long"
    read = [("t", None, "tags", "x", "2024-01-02", 5)]
    late = [("t", None, "tags", "y", "2024-01-01", 5), ("u", None, "tags", None, "2024-01-02", 3)]
    left = consume_edits(spark.createDataFrame(read + late, schema), spark.createDataFrame(read, schema))
    assert sorted(map(tuple, left.collect())) == sorted(late)


def test_an_edit_that_does_not_cast_is_reported_and_changes_nothing(spark):
    target = spark.createDataFrame([("t", 7, "old", None)], "table_name string, row_count long, tags string, updated_at string")
    log = spark.createDataFrame([("t", "row_count", "abc", "2024-01-01", 0), ("t", "tags", "new", "2024-01-01", 1)],
                                "table_name string, field string, value string, edited_at string, seq long")
    row = apply_edits(target, log, ["table_name"], "N").first()
    assert (row.row_count, row.tags, row.updated_at) == (7, "new", "N")
    assert [r.value for r in bad_edits(log, target.schema).collect()] == ["abc"]


def test_writers_with_one_current_version_both_survive(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cat")
    frame = spark.createDataFrame([(1,)], "a int")
    monkeypatch.setattr(store, "current", lambda *a: None)
    versions = [store.write_snapshot(frame.withColumn("w", F.lit(i)), root, "t") for i in range(2)]
    monkeypatch.undo()
    assert versions == [0, 1]
    log = store._read_log(spark, root, "t").collect()
    assert sorted(spark.read.parquet(r.path).first().w for r in log) == [0, 1]


def test_a_source_that_raises_any_error_is_isolated(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no parquet")

    def broken():
        raise ValueError("first line\nsecond line " + "x" * 600)
    out = scan(spark, {"ok": spark.range(3).toDF("a"), "boom": broken, "empty": lambda: 1 / 0,
                       "corrupt": lambda: spark.read.schema("a long").parquet(str(tmp_path / "bad.parquet"))}, "2024-01-01T00:00:00")
    errors = {r.table_name: r.error for r in out.errors.collect()}
    assert set(errors) == {"boom", "empty", "corrupt"}
    assert errors["boom"].startswith("first line\nsecond line") and len(errors["boom"]) > 600
    assert [r.table_name for r in out.tables.collect()] == ["ok"]


def test_replies_must_be_one_json_value(spark):
    rows = [("a", '{"description":"x"}'), ("b", '{"description":"x"} trailing words'), ("c", '{"description":"x"} {"description":"y"}'),
            ("d", None), ("e", '{"description":"x"}]')]
    bad = {r.table_name: r.is_bad for r in parse_replies(spark.createDataFrame(rows, "table_name string, response string")).collect()}
    assert bad == {"a": False, "b": True, "c": True, "d": True, "e": True}
    rows = [("a", '[{"column_name":"x"}]'), ("b", '[{"column_name":"x"}] and done')]
    assert [r.table_name for r in explode_replies(spark.createDataFrame(rows, "table_name string, response string")).collect()] == ["a"]


def test_search_ignores_case_beyond_ascii(spark):
    df = spark.createDataFrame([("été", "d", "gld")], "table_name string, description string, layer string")
    assert search_tables(df, text="ÉT", fields=["table_name"]).count() == 1


def test_distinct_keys_of_nested_values(spark):
    df = spark.sql("""SELECT * FROM VALUES (array('a, b'), named_struct('t', timestamp'2024-01-01 00:00:00.000001')),
        (array('a', 'b'), named_struct('t', timestamp'2024-01-01 00:00:00.000002')) AS v(a, s)""")
    got = {r.column_name: r.distinct_count for r in profile(df, "t").collect()}
    assert got == {"a": 2, "s": 2}
