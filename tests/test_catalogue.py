"""The end-to-end workflows on the sf0.001 driver tables."""

import datetime as dt

from pyspark.sql import functions as F

from lakeledger import catalogue
from lakeledger.operators.edits import append_edits, consume_edits
from lakeledger.sources import store
from lakeledger.sources.tables import declared_key_metadata, driver_sources
from lakeledger.sources.scan import primary_keys
from tests.conftest import SF_SMALL


def test_refresh_stats_edit_cleanup(spark, tmp_path):
    root, log = str(tmp_path / "cat"), str(tmp_path / "log")
    sources = driver_sources(spark, SF_SMALL)
    keys = primary_keys(*declared_key_metadata(spark))

    r = catalogue.refresh(spark, sources, root, "2024-03-01T00:00:00", keys)
    assert (r.tables_version, r.columns_version) == (1, 1)
    t = store.load_tables(spark, root)
    assert t.count() == 14
    assert t.filter("table_name = 'brz_lineitem'").first().row_count == 6000

    catalogue.refresh_stats(spark, sources, root, batch_tables=5)
    c = store.load_columns(spark, root, "brz_orders").collect()
    assert [x.column_name for x in c][:2] == ["o_orderkey", "o_custkey"]
    assert c[0].distinct_count == 1500 and c[0].is_primary_key and c[0].null_percentage == 0.0

    edits = spark.createDataFrame(
        [("brz_orders", None, "description", "Orders", dt.datetime(2024, 3, 2)),
         ("brz_orders", "o_custkey", "business_name", "Customer", dt.datetime(2024, 3, 2))],
        "table_name string, column_name string, field string, value string, edited_at timestamp_ntz")
    append_edits(log, edits)
    applied = spark.read.parquet(log)
    catalogue.apply_queued(spark, root, log, "2024-03-03T00:00:00")
    assert consume_edits(spark.read.parquet(log), applied).count() == 0
    assert store.load_tables(spark, root).filter("table_name = 'brz_orders'").first().description == "Orders"
    cc = store.load_columns(spark, root, "brz_orders").filter("column_name = 'o_custkey'").first()
    assert (cc.business_name, cc.distinct_count) == ("Customer", 150)

    # a re-scan keeps the description and the statistics are reset (Q6)
    catalogue.refresh(spark, sources, root, "2024-03-04T00:00:00", keys)
    t = store.load_tables(spark, root).filter("table_name = 'brz_orders'").first()
    assert (t.description, t.scanned_at) == ("Orders", "2024-03-04T00:00:00")

    live = spark.createDataFrame([(n,) for n in sources if n != "brz_pages"], "table_name string")
    catalogue.cleanup(spark, root, live)
    assert store.load_tables(spark, root).count() == 13
    assert store.load_columns(spark, root).filter(F.col("table_name") == "brz_pages").count() == 0
