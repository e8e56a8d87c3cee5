"""Reading a folder of parquet tables as named sources."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from lakeledger.sources.schema import metadata_frame

# ---- fixed values ----------------------------------------------------------
# The driver's tables, and the names they are catalogued under (a layer
# prefix each; the last stays in layer "other").
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]
CATALOGUE_NAMES = {
    "region": "ref_region", "nation": "ref_nation", "customer": "slv_customer",
    "supplier": "slv_supplier", "part": "slv_part", "orders": "brz_orders",
    "lineitem": "brz_lineitem", "events": "brz_events", "documents": "slv_documents",
    "embeddings": "gld_embeddings", "pages": "brz_pages", "benchmark": "utl_benchmark",
    "labels": "dq_labels", "conversations": "conversations",
}
# Declared primary keys of the driver tables (lakehouse files carry none).
DECLARED_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
# ---------------------------------------------------------------------------


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_sources(spark: SparkSession, paths: dict[str, str], threads: int = 16) -> dict[str, DataFrame]:
    """``{name: spark.read.parquet(path)}`` with the readers created in
    parallel: creating a reader lists files and reads a footer for the
    schema, a driver round trip per table that adds up over thousands of
    tables.  No data is read here."""
    names = list(paths)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(names)))) as ex:
        frames = list(ex.map(lambda n: spark.read.parquet(paths[n]), names))
    return dict(zip(names, frames))


def driver_sources(spark: SparkSession, sf_dir: str, catalogue_names: bool = True) -> dict[str, DataFrame]:
    """All driver tables as ``{name: DataFrame}``, under catalogue names."""
    return read_sources(spark, {(CATALOGUE_NAMES[t] if catalogue_names else t): table_path(sf_dir, t)
                                for t in DRIVER_TABLES})


def declared_key_metadata(spark: SparkSession, schema: str = "dbo") -> tuple[DataFrame, DataFrame]:
    """Constraint and key-usage frames (the shape of a SQL catalogue's
    TABLE_CONSTRAINTS / KEY_COLUMN_USAGE) for the declared keys."""
    cons, usage = [], []
    for t, cols in DECLARED_KEYS.items():
        cname = f"pk_{t}"
        cons.append((cname, "PRIMARY KEY", schema))
        usage.extend((cname, CATALOGUE_NAMES[t], c) for c in cols)
    return (metadata_frame(spark, cons, "CONSTRAINT_NAME string, CONSTRAINT_TYPE string, TABLE_SCHEMA string"),
            metadata_frame(spark, usage, "CONSTRAINT_NAME string, TABLE_NAME string, COLUMN_NAME string"))


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """S1 over a Spark catalog: the base tables of ``database`` (views and
    temporary views left out), as a ``table_name`` frame for ``live_tables``.
    Catalog metadata only; bounded by the number of tables."""
    rows = [(t.name,) for t in spark.catalog.listTables(database)
            if not t.isTemporary and (t.tableType or "").upper() not in ("VIEW", "TEMPORARY")]
    return metadata_frame(spark, rows, "table_name string")


def catalog_sources(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """``{name: spark.table(...)}`` for the base tables of ``database``."""
    db = database or spark.catalog.currentDatabase()
    names = [r.table_name for r in catalog_tables(spark, db).collect()]
    return {n: spark.table(f"`{db}`.`{n}`") for n in names}
