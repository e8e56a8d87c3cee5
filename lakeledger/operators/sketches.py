"""Distinct counts from stored sketches (A4): kept per part of a table, merged at refresh.

``profile(mode="approx")`` reads a whole table for every refresh.  A table
that grows by parts (days, loads, files) needs only its new parts read: each
part's columns are summed up once in HyperLogLog sketches (4 KB a column at
the default size), the sketches are stored, and a column's estimate is the
union of its parts' sketches.  A part that is summed up again replaces what
was stored for it, so nothing counts twice.

Values are sketched in the form the exact profile groups them by, so equal
values are equal here too (NaNs, signed zeros, nested values).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.operators.profile import _ident, _text_sql, _zero_sql, null_percentage
from lakeledger.sources.schema import union_all

#: log2 of a sketch's registers: the estimate's relative error is about 1.6 %.
LG_K = 12

SKETCH_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("part", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("ordinal_position", T.IntegerType(), False),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("null_count", T.LongType(), False),
    T.StructField("sketch", T.BinaryType(), False),
])


def relative_error(lg_k: int = LG_K) -> float:
    """Standard error of a merged sketch's estimate, relative to the count."""
    return 1.04 / math.sqrt(2 ** lg_k)


def _key_sql(f: T.StructField) -> str:
    """A column's value in a type that sketches take, equal where SQL equality holds.

    Sketches skip empty texts, which are values here: they get a mark (and so
    do texts that begin with it)."""
    c = _ident(f.name)
    if isinstance(f.dataType, (T.LongType, T.IntegerType)):
        return c
    if isinstance(f.dataType, (T.ByteType, T.ShortType)):
        return f"CAST({c} AS INT)"
    if isinstance(f.dataType, T.StringType):
        return f"CASE WHEN {c} = '' OR startswith({c}, chr(0)) THEN concat(chr(0), {c}) ELSE {c} END"
    if isinstance(f.dataType, T.BinaryType):
        return f"concat('b', base64({c}))"
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return f"CAST({_zero_sql(c, f.dataType)} AS STRING)"
    return _text_sql(c, f.dataType)


def column_sketches(df: DataFrame, table_name: str, part: Column | str | None = None, lg_k: int = LG_K) -> DataFrame:
    """Rows of ``SKETCH_SCHEMA`` for every column of ``df`` and every part of it.

    ``part`` tells a row's part (a Column), or names the part that all of
    ``df`` is.  One aggregate: each task sends one sketch per part and column,
    however many rows or distinct values there are.  NULL parts are the part
    ``''``.  A frame without rows has no part, unless it was named."""
    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame([], SKETCH_SCHEMA)
    named = part is None or isinstance(part, str)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.expr(f"count({_ident(f.name)})").alias(f"_n{i}"))
        aggs.append(F.expr(f"hll_sketch_agg({_key_sql(f)}, {int(lg_k)})").alias(f"_s{i}"))
    if named:
        one = df.agg(*aggs).withColumn("_part", F.lit(part or ""))
    else:
        one = df.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("_part")).agg(*aggs)
    rows = ", ".join(f"'{_text(f.name)}', {i + 1}, _rows - _n{i}, _s{i}" for i, f in enumerate(fields))
    out = one.selectExpr("_part", "_rows", f"stack({len(fields)}, {rows}) AS (column_name, ordinal_position, null_count, sketch)")
    return out.select(F.lit(table_name).alias("table_name"), F.col("_part").alias("part"), "column_name", "ordinal_position",
                      F.col("_rows").alias("row_count"), "null_count", "sketch")


def _text(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")


def sketch_all(sources: Mapping[str, DataFrame], parts: Mapping[str, Column | str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """``column_sketches`` of many tables as one frame; ``parts`` names the part or part column of some."""
    return union_all([column_sketches(df, name, (parts or {}).get(name), lg_k) for name, df in sources.items()])


def replace_parts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sketches with the parts in ``new`` put in place of what they had."""
    keys = ["table_name", "part"]
    kept = stored.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.select(SKETCH_SCHEMA.fieldNames()).unionByName(new.select(SKETCH_SCHEMA.fieldNames()))


def drop_parts(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored sketches without the parts ``gone(table_name, part)``: the table dropped them."""
    return stored.join(gone.select("table_name", "part").distinct(), ["table_name", "part"], "left_anti").select(SKETCH_SCHEMA.fieldNames())


def sketch_profile(sketches: DataFrame) -> DataFrame:
    """Statistics per column from its parts' sketches, in the form of ``profile`` (fits ``attach_stats``).

    ``distinct_count`` is an estimate with ``relative_error``; rows and NULLs
    are exact.  Sketches of different sizes merge at the smaller size."""
    merged = sketches.groupBy("table_name", "column_name").agg(
        F.max("ordinal_position").alias("ordinal_position"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("_distinct"))
    some = F.col("row_count") > 0
    return merged.select("table_name", "column_name", "ordinal_position", "row_count",
                         F.when(some, F.col("_nulls")).alias("null_count"), null_percentage("_nulls", "row_count").alias("null_percentage"),
                         F.when(some, F.col("_distinct")).alias("distinct_count"))
