"""Schema fitting, the JSON sink, point updates, search helpers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.functions.empties import differs_text, first_truthy, has_text, nullify_empty
from lakeledger.functions.text import iso_text
from lakeledger.operators.reconcile import update_fields
from lakeledger.operators.report import export_nested, table_header, write_export
from lakeledger.plans.fixtures import Fixtures
from lakeledger.sources.schema import TABLES_SCHEMA, align_to, restrict_to_target, select_existing
from tests.conftest import SF_SMALL


def test_select_existing_and_align_to(spark):
    df = spark.createDataFrame([(1, "x")], "Table_Name long, extra string")
    assert select_existing(df, ["extra", "missing", "Table_Name"]).columns == ["extra", "Table_Name"]
    target = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("row_count", T.LongType())])
    a = align_to(df, target)
    assert a.columns == ["table_name", "row_count"]
    assert a.first() == ("1", None)
    assert restrict_to_target(TABLES_SCHEMA, ["TABLE_NAME", "Layer"]).fieldNames() == ["table_name", "layer"]


def test_empty_rules(spark):
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("x", "c")], "v string, w string")
    r = df.select(nullify_empty("v").alias("n"), has_text("v").alias("h"),
                  first_truthy("v", "w").alias("f"), differs_text("v", F.lit("")).alias("d")).collect()
    assert [tuple(x) for x in r] == [(None, False, "a", False), (None, False, "b", False), ("x", True, "x", True)]


def test_iso_text_matches_python_isoformat(spark):
    import datetime as dt
    vals = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120)]
    df = spark.createDataFrame([(v,) for v in vals], "t timestamp_ntz")
    assert [r[0] for r in df.select(iso_text("t")).collect()] == [v.isoformat() for v in vals]


def test_update_fields_sets_null_and_stamps(spark):
    t = Fixtures(spark, SF_SMALL).fx_tables
    name = t.orderBy("table_name").first().table_name
    e = spark.createDataFrame([(name, None, "Ops")], "table_name string, description string, business_owner string")
    r = update_fields(t, e, ["table_name"], "NOW").filter(F.col("table_name") == name).first()
    assert (r.description, r.business_owner, r.updated_at) == (None, "Ops", "NOW")
    with pytest.raises(ValueError):
        update_fields(t, e.withColumn("nope", F.lit(1)), ["table_name"], "NOW")


def test_write_export_json_lines(spark, tmp_path):
    fx = Fixtures(spark, SF_SMALL)
    out = str(tmp_path / "export")
    write_export(export_nested(fx.fx_tables, fx.fx_columns), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    docs = [json.loads(x) for x in lines]
    assert len(docs) == fx.fx_tables.count()
    d = next(x for x in docs if x["columns"])
    assert list(d)[:2] == ["table_name", "layer"] and "updated_by" in d
    assert [c["ordinal_position"] for c in d["columns"]] == sorted(c["ordinal_position"] for c in d["columns"])
    assert any(x["columns"] == [] for x in docs) or all(x["columns"] for x in docs)


def test_table_header_point_lookup(spark):
    t = Fixtures(spark, SF_SMALL).fx_tables
    name = t.filter(F.col("row_count").isNull()).orderBy("table_name").first().table_name
    h = table_header(t, name).collect()
    assert len(h) == 1 and h[0].rows_text == "?" and h[0].last_scanned == "2024-01-01T00:00:00"


def test_value_text_column_and_sql_forms_agree(spark):
    from lakeledger.functions.text import value_text
    from lakeledger.operators.profile import _ident, _text_sql
    df = spark.sql("SELECT map('b', 1, 'a', 2) m, named_struct('x', CAST(NULL AS INT)) st, "
                   "binary('ab') bi, array(named_struct('y', 1)) ar, DATE'2024-01-02' dt, array(-0.0D, 1.5D) ad")
    for f in df.schema.fields:
        a = df.select(value_text(df[f.name], f.dataType)).first()[0]
        b = df.selectExpr(_text_sql(_ident(f.name), f.dataType)).first()[0]
        assert a == b, f.name


def test_export_with_map_valued_column_rows(spark):
    t = Fixtures(spark, SF_SMALL).fx_tables.limit(3)
    names = [r.table_name for r in t.collect()]
    cols = spark.createDataFrame([(names[0], "b", 2, {"k": "v"}), (names[0], "a", 1, None)],
                                 "table_name string, column_name string, ordinal_position int, tags map<string,string>")
    r = {x.table_name: x.column_names for x in export_nested(t, cols).collect()}
    assert r[names[0]] == "a,b" and r[names[1]] == ""


def test_nullify_fields_before_save(spark):
    from lakeledger.operators.suggest import nullify_fields
    df = spark.createDataFrame([("a", "", "x"), ("b", None, "")], "k string, d string, o string")
    assert [tuple(r) for r in nullify_fields(df, ["d"]).collect()] == [("a", None, "x"), ("b", None, "")]


def test_checkpoint_root_comes_from_the_session(spark):
    from lakeledger.session import checkpoint_root, scratch_path
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root)
