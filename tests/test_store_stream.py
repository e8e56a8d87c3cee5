"""Snapshot store, edit log appends and the streaming applier."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeledger.operators.edits import append_edits
from lakeledger.plans.fixtures import Fixtures
from lakeledger.sources import store
from lakeledger.sources.scan import scan
from lakeledger.sources.schema import TABLES_SCHEMA
from lakeledger.sources.tables import driver_sources, read_table
from lakeledger.streaming.edit_stream import apply_edit_stream
from tests.conftest import SF_SMALL


def test_snapshots_version_and_read_back(spark, tmp_path):
    root = str(tmp_path / "cat")
    with pytest.raises(FileNotFoundError):
        store.load_tables(spark, root)
    store.ensure_catalogue(spark, root)
    assert store.load_tables(spark, root).count() == 0
    t = Fixtures(spark, SF_SMALL).fx_tables
    v = store.save_tables(t, root)
    assert v == 1
    back = store.load_tables(spark, root)
    assert back.schema == TABLES_SCHEMA or back.columns == TABLES_SCHEMA.fieldNames()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    # a job reading v1 and writing v2 never overwrites what it reads
    v2 = store.save_tables(back.withColumn("tags", F.lit("z")), root)
    assert v2 == 2 and store.load_tables(spark, root).filter("tags = 'z'").count() == t.count()
    assert store.probe(spark, store.current(spark, root, store.TABLES)[1])
    assert not store.probe(spark, f"{root}/nothing")


def test_layer_filter_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "cat")
    store.save_tables(Fixtures(spark, SF_SMALL).fx_tables, root)
    df = store.load(spark, root, store.TABLES).filter("layer = 'gld'")
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(layer" in plan


def test_scan_isolates_a_broken_source(spark):
    sources = driver_sources(spark, SF_SMALL)
    sources["brz_missing"] = lambda: spark.read.parquet("/nonexistent/x.parquet")
    sources["dd_internal"] = sources["ref_region"]
    res = scan(spark, sources, "2024-01-01T00:00:00")
    names = {r.table_name for r in res.tables.collect()}
    assert "brz_missing" not in names and "dd_internal" not in names and len(names) == 14
    assert [r.table_name for r in res.errors.collect()] == ["brz_missing"]
    assert res.columns.count() == 63


def test_append_and_stream_apply_consume_the_queue(spark, tmp_path):
    root, log = str(tmp_path / "cat"), str(tmp_path / "log")
    fx = Fixtures(spark, SF_SMALL)
    store.save_tables(fx.fx_tables, root)
    name = fx.fx_tables.orderBy("table_name").first().table_name
    t0 = dt.datetime(2024, 5, 1)
    first = spark.createDataFrame([(name, "description", "first", t0)],
                                  "table_name string, field string, value string, edited_at timestamp_ntz")
    assert append_edits(log, first) == 0
    q = apply_edit_stream(spark, log, root, "tables", checkpoint=str(tmp_path / "ck"), now_fn=lambda: "N1")
    q.awaitTermination()
    row = store.load_tables(spark, root).filter(F.col("table_name") == name).first()
    assert (row.description, row.updated_at) == ("first", "N1")
    second = spark.createDataFrame([(name, "tags", "t2", t0 + dt.timedelta(days=1))], first.schema)
    assert append_edits(log, second) >= 1
    q = apply_edit_stream(spark, log, root, "tables", checkpoint=str(tmp_path / "ck"), now_fn=lambda: "N2")
    q.awaitTermination()
    row = store.load_tables(spark, root).filter(F.col("table_name") == name).first()
    assert (row.description, row.tags, row.updated_at) == ("first", "t2", "N2")
    assert store.current(spark, root, store.TABLES)[0] == 2
    assert read_table(spark, SF_SMALL, "region").count() == 5


def test_catalog_sources_list_base_tables_only(spark):
    from lakeledger.sources.scan import live_tables, scan_tables
    from lakeledger.sources.tables import catalog_sources, catalog_tables
    spark.sql("CREATE DATABASE IF NOT EXISTS lk_test")
    read_table(spark, SF_SMALL, "region").write.mode("overwrite").saveAsTable("lk_test.ref_region")
    read_table(spark, SF_SMALL, "nation").write.mode("overwrite").saveAsTable("lk_test.dd_internal")
    spark.sql("CREATE OR REPLACE VIEW lk_test.slv_view AS SELECT * FROM lk_test.ref_region")
    names = [r.table_name for r in live_tables(catalog_tables(spark, "lk_test")).collect()]
    assert names == ["ref_region"]
    src = catalog_sources(spark, "lk_test")
    assert set(src) == {"ref_region", "dd_internal"}
    rows = {r.table_name: r.row_count for r in scan_tables(spark, src, "now").collect()}
    assert rows == {"ref_region": 5, "dd_internal": 25}


def test_stream_applies_column_edits_keeping_empty_text(spark, tmp_path):
    root, log = str(tmp_path / "cat"), str(tmp_path / "log")
    fx = Fixtures(spark, SF_SMALL)
    store.save_columns(fx.fx_columns, root)
    key = fx.fx_columns.orderBy("table_name", "column_name").first()
    t0 = dt.datetime(2024, 6, 1)
    edits = spark.createDataFrame(
        [(key.table_name, key.column_name, "description", "", t0),
         (key.table_name, key.column_name, "business_name", None, t0),
         (key.table_name, None, "description", "table-level", t0)],
        "table_name string, column_name string, field string, value string, edited_at timestamp_ntz")
    append_edits(log, edits)
    q = apply_edit_stream(spark, log, root, "columns", checkpoint=str(tmp_path / "ck"), now_fn=lambda: "N")
    q.awaitTermination()
    row = store.load_columns(spark, root, key.table_name).filter(F.col("column_name") == key.column_name).first()
    assert (row.description, row.business_name, row.updated_at) == ("", key.business_name, "N")


def test_stream_with_late_edit_equals_batch_apply(spark, tmp_path):
    from lakeledger.operators.edits import apply_edits
    root, log = str(tmp_path / "cat"), str(tmp_path / "log")
    fx = Fixtures(spark, SF_SMALL)
    store.save_tables(fx.fx_tables, root)
    name = fx.fx_tables.orderBy("table_name").first().table_name
    schema = "table_name string, field string, value string, edited_at timestamp_ntz"
    newer = spark.createDataFrame([(name, "description", "newer", dt.datetime(2024, 6, 2))], schema)
    older = spark.createDataFrame([(name, "description", "older", dt.datetime(2024, 6, 1)),
                                   (name, "tags", "late-but-only", dt.datetime(2024, 6, 1))], schema)
    ck = str(tmp_path / "ck")
    append_edits(log, newer)
    apply_edit_stream(spark, log, root, "tables", checkpoint=ck, now_fn=lambda: "N1").awaitTermination()
    append_edits(log, older)
    apply_edit_stream(spark, log, root, "tables", checkpoint=ck, now_fn=lambda: "N2").awaitTermination()
    got = store.load_tables(spark, root).filter(F.col("table_name") == name).first()
    whole = apply_edits(fx.fx_tables, spark.read.parquet(log), ["table_name"], "N") \
        .filter(F.col("table_name") == name).first()
    assert (got.description, got.tags) == (whole.description, whole.tags) == ("newer", "late-but-only")
