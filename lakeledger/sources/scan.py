"""Scanning live tables into table rows and column rows.

A *source* is a name and a DataFrame (usually ``spark.read.parquet``).  The
structure of every source comes from its schema (no data read); row counts
of all sources run as one Spark job; everything else is a small join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.functions.layers import EXCLUDE_PREFIXES, detect_layer, excluded
from lakeledger.sources.schema import metadata_frame, union_all

LIVE_COLUMNS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("ordinal_position", T.IntegerType(), False),
    T.StructField("is_nullable", T.StringType(), False),
])


def live_tables(names: DataFrame, exclude=EXCLUDE_PREFIXES, name_col: str = "table_name") -> DataFrame:
    """Names not starting with an excluded prefix, sorted by name."""
    return (names.select(F.col(name_col).alias("table_name"))
            .filter(~F.coalesce(excluded("table_name", exclude), F.lit(False)))
            .orderBy("table_name"))


def live_columns(spark: SparkSession, sources: Mapping[str, DataFrame], ordered: bool = True) -> DataFrame:
    """One row per column of every source, ordinal 1-based.

    Built from the schemas only (metadata, bounded by the number of columns);
    no data is read.  Sorted by table, ordinal unless ``ordered=False`` (for
    callers that join it, where an order would be wasted work)."""
    rows = []
    for name, df in sources.items():
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((name, f.name, f.dataType.simpleString(), i, "YES" if f.nullable else "NO"))
    df = metadata_frame(spark, rows, LIVE_COLUMNS_SCHEMA)
    return df.orderBy("table_name", "ordinal_position") if ordered else df


def _count_parts(spark: SparkSession, sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources' rows as ``(table_name, one, column_count)`` plus one
    metadata row per source, so a single grouped aggregation yields every
    count (zero-row sources included) with one shuffle for all sources.
    Partial aggregation leaves one row per source and map task."""
    meta = spark.createDataFrame([(n, 0, len(df.schema.fields)) for n, df in sources.items()],
                                 "table_name string, one int, column_count int")
    parts = [df.select(F.lit(name).alias("table_name"), F.lit(1).alias("one"),
                       F.lit(None).cast("int").alias("column_count"))
             for name, df in sources.items()]
    return union_all([meta, *parts])


def row_counts(spark: SparkSession, sources: Mapping[str, DataFrame]) -> DataFrame:
    """S3: ``(table_name, row_count)`` for every source, as one job.

    No column is read from parquet (the projection is a literal)."""
    return (_count_parts(spark, sources).groupBy("table_name")
            .agg(F.sum("one").cast("long").alias("row_count")))


def scan_tables(spark: SparkSession, sources: Mapping[str, DataFrame], now: str) -> DataFrame:
    """``table_name, layer, row_count, column_count, scanned_at``.

    ``now`` is one ISO timestamp for the whole scan (never per row)."""
    g = _count_parts(spark, sources).groupBy("table_name").agg(
        F.sum("one").cast("long").alias("row_count"), F.max("column_count").alias("column_count"))
    return g.select("table_name", detect_layer("table_name").alias("layer"),
                    "row_count", "column_count", F.lit(now).alias("scanned_at"))


def primary_keys(constraints: DataFrame, usage: DataFrame, schema: str | None = "dbo") -> DataFrame:
    """Key columns ``(table_name, column_name)`` from constraint metadata.

    ``constraints``: CONSTRAINT_NAME, CONSTRAINT_TYPE, TABLE_SCHEMA;
    ``usage``: CONSTRAINT_NAME, TABLE_NAME, COLUMN_NAME."""
    c = constraints.filter(F.col("CONSTRAINT_TYPE") == "PRIMARY KEY")
    if schema is not None:
        c = c.filter(F.col("TABLE_SCHEMA") == schema)
    return (usage.join(c.select("CONSTRAINT_NAME"), "CONSTRAINT_NAME", "inner")
            .select(F.col("TABLE_NAME").alias("table_name"),
                    F.col("COLUMN_NAME").alias("column_name"))
            .distinct())


def keys_by_table(keys: DataFrame) -> DataFrame:
    """The key columns of each table as a sorted array (bounded by width)."""
    return keys.groupBy("table_name").agg(
        F.array_sort(F.collect_set("column_name")).alias("key_columns"))


def scan_columns(cols: DataFrame, keys: DataFrame | None, now: str) -> DataFrame:
    """Column rows; ``is_primary_key`` from ``keys``; statistics NULL."""
    if keys is None:
        flagged = cols.withColumn("is_primary_key", F.lit(False))
    else:
        k = keys.select("table_name", "column_name").distinct().withColumn("_key", F.lit(True))
        flagged = (cols.join(k, ["table_name", "column_name"], "left")
                   .withColumn("is_primary_key", F.col("_key").isNotNull()))
    return flagged.select(
        "table_name", "column_name", "data_type",
        F.col("ordinal_position").cast("int").alias("ordinal_position"),
        "is_nullable", "is_primary_key",
        F.lit(None).cast("double").alias("null_percentage"),
        F.lit(None).cast("long").alias("distinct_count"),
        F.lit(None).cast("string").alias("sample_values"),
        F.lit(now).alias("scanned_at"))


def scan_totals(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Number of scanned tables and columns, one row, one job."""
    both = (tables.select(F.lit(1).alias("t"), F.lit(0).alias("c"))
            .unionByName(columns.select(F.lit(0).alias("t"), F.lit(1).alias("c"))))
    return both.agg(F.sum("t").cast("long").alias("tables"),
                    F.sum("c").cast("long").alias("columns"))


@dataclass
class ScanResult:
    tables: DataFrame
    columns: DataFrame
    errors: DataFrame


def error_class(e: BaseException) -> str:
    """A short name of a failure: Spark's error condition where it has one, else the exception's type."""
    condition = getattr(e, "getCondition", lambda: None)()
    found = re.search(r"\[([A-Z][A-Z0-9_]+(?:\.[A-Z0-9_]+)*)\]", str(e))
    return condition or (found[1] if found else type(e).__name__)


def isolate(names: list[str], run: Callable[[list[str]], list], threads: int = 8) -> tuple[list, list[tuple[str, Exception]]]:
    """Run ``run(group)`` over all names and find those that make it fail.

    One call for all names first.  A group that fails is halved, and all
    groups of a level run as concurrent jobs, so k failures among n names
    cost about k log2(n) jobs on log2(n) levels, not n jobs in a row.  Returns
    the collected results of the groups that went through, and the names that
    failed alone with what they raised."""
    done, failed, groups = [], [], [list(names)] if names else []

    def attempt(group: list[str]):
        try:
            return run(group), None
        except Exception as e:  # noqa: BLE001 - any failure of a group is looked into
            return None, e

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        while groups:
            halves = []
            for group, (result, error) in zip(groups, pool.map(attempt, groups)):
                if error is None:
                    done.extend(result)
                elif len(group) == 1:
                    failed.append((group[0], error))
                else:
                    halves += [group[:len(group) // 2], group[len(group) // 2:]]
            groups = halves
    return done, sorted(failed, key=lambda f: f[0])


def scan(spark: SparkSession,
         sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
         now: str,
         keys: DataFrame | None = None,
         exclude=EXCLUDE_PREFIXES,
         isolate_failures: bool = True,
         threads: int = 8) -> ScanResult:
    """Scan many sources; a failing source is skipped with a message.

    Sources may be DataFrames or callables returning one (e.g. a reader), so
    a path that cannot be read fails inside the scan, not before it.  Readers
    run ``threads`` at a time (each is a driver round trip).  Analysis errors,
    and any other exception a source raises, are caught per source and kept
    with their full text.  With ``isolate_failures`` the row counts run once
    for all sources; if that job fails, ``isolate`` finds the broken ones.
    ``errors`` has ``table_name, error_class, error``, one row per source that
    failed.  The result is one row per table, so what passes through the
    driver is bounded by the number of tables."""
    names = [n for n in sorted(sources) if not any(n.startswith(p) for p in exclude)]

    def opened(name: str):
        try:
            df = sources[name]() if callable(sources[name]) else sources[name]
            _ = df.schema  # forces analysis
            return df
        except Exception as e:  # noqa: BLE001 - any failure of one source is that source's
            return e

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        frames = dict(zip(names, pool.map(opened, names)))
    failed = [(n, f) for n, f in frames.items() if isinstance(f, Exception)]
    ok = {n: f for n, f in frames.items() if not isinstance(f, Exception)}

    tables = scan_tables(spark, ok, now)
    if isolate_failures and ok:
        rows, broken = isolate(list(ok), lambda group: scan_tables(spark, {n: ok[n] for n in group}, now).collect(), threads)
        tables = metadata_frame(spark, rows, tables.schema)
        failed += broken
        for name, _ in broken:
            ok.pop(name)
    cols = live_columns(spark, ok, ordered=False)
    columns = scan_columns(cols, keys, now)
    err = metadata_frame(spark, [(n, error_class(e), str(e) or repr(e)) for n, e in sorted(failed, key=lambda f: f[0])],
                         "table_name string, error_class string, error string")
    return ScanResult(tables, columns, err)
