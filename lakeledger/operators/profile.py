"""Column profiling: NULL share, distinct count, sample values.

Exact plan (default).  Every cell of every source is unpivoted into
``(col_id, kind, l, d, s)``: the column as a global integer id, and the value
as a long (integers, booleans, dates, timestamps), a double, or an injective
text (everything else, ``value_text``).  One grouped count on that shape,
``value_counts``, serves everything:

- rows and NULLs of a column are sums over its groups, its distinct count is
  the number of non-NULL groups (``column_stats``);
- samples are the smallest distinct 200-character heads of the same groups
  (``samples_from_counts``).

So each source is scanned once and there is one wide shuffle, whose map side
already collapses repeated values (partial aggregation).  A value that holds a
third of all rows is one partial row per map task, not a hot reducer.  The
second level (per column) only ever sees one row per column per partition.
Sample picking uses a row_number limit that Spark runs as a partial
WindowGroupLimit before its shuffle, so at most ``n + 1`` rows per column and
map task move, however many distinct values a column has.  Names come back
from the column list (``Slots``, one row per column) at the very end.

Approximate plan (``mode="approx"``): one global aggregate with
``approx_count_distinct`` per column, no wide shuffle at all; same schema.
Digest plan (``mode="digest"``): as exact, with long texts keyed by SHA-256.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.operators.reconcile import guard_unique
from lakeledger.sources.schema import metadata_frame, union_all

# ---- fixed values ----------------------------------------------------------
SAMPLE_COUNT = 5          # distinct values per column
SAMPLE_WIDTH = 200        # characters kept of each value, before de-duplication
SAMPLE_SEPARATOR = " | "
DIGEST_OVER = 256         # digest mode: texts longer than this are keyed by SHA-256
# ---------------------------------------------------------------------------

# Kinds of values, by how they are grouped (as a long, a double or a text)
# and how they are written back as text for samples.
K_TEXT, K_INT, K_BOOL, K_DATE, K_TS, K_DOUBLE, K_FLOAT = range(7)


def _kind(dtype: T.DataType) -> int:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return K_INT
    for t, k in ((T.BooleanType, K_BOOL), (T.DateType, K_DATE), (T.TimestampType, K_TS),
                 (T.DoubleType, K_DOUBLE), (T.FloatType, K_FLOAT)):
        if isinstance(dtype, t):
            return k
    return K_TEXT


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


_NULL_L, _NULL_D, _NULL_S = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.keyType) or _has_float(dtype.valueType)
    return False


def _zero_sql(e: str, dtype: T.DataType, depth: int = 0) -> str:
    """``e`` with every float/double -0.0 inside it turned into 0.0 (SQL
    equality and Spark grouping treat them as one value; their text does not)."""
    if not _has_float(dtype):
        return e
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN {e} = 0 THEN CAST(0.0 AS {dtype.simpleString()}) ELSE {e} END"
    if isinstance(dtype, T.ArrayType):
        x = f"_x{depth}"
        return f"transform({e}, {x} -> {_zero_sql(x, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.StructType):
        parts = ", ".join(f"'{f.name.replace(chr(39), chr(39) * 2)}', "
                          f"{_zero_sql(e + '.' + _ident(f.name), f.dataType, depth + 1)}" for f in dtype.fields)
        return f"CASE WHEN {e} IS NULL THEN NULL ELSE named_struct({parts}) END"
    return e  # maps are normalised entry by entry in _text_sql


# JSON text that keeps NULL fields and microseconds, so distinct values differ.
_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_JSON = f"map('ignoreNullFields', 'false', 'timestampFormat', '{_MICROS}', 'timestampNTZFormat', '{_MICROS}')"


def _text_sql(c: str, dtype: T.DataType) -> str:
    """``value_text`` as a SQL expression (same forms; signed zeros inside
    nested values are folded as well)."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return f"base64({c})"
    if isinstance(dtype, T.MapType):
        entries = f"map_entries({c})"
        if _has_float(dtype):
            kv = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
            entries = f"transform({entries}, _kv -> {_zero_sql('_kv', kv, 1)})"
        return f"to_json(array_sort({entries}), {_JSON})"
    if isinstance(dtype, T.StructType) or (isinstance(dtype, T.ArrayType) and
                                            isinstance(dtype.elementType, (T.StructType, T.MapType,
                                                                           T.ArrayType, T.BinaryType, T.StringType,
                                                                           T.TimestampType, T.TimestampNTZType))):
        return f"to_json({_zero_sql(c, dtype)}, {_JSON})"
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
        # -0.0 and 0.0 are one value inside arrays too (as Spark groups them)
        return f"CAST({_zero_sql(c, dtype)} AS STRING)"
    return f"CAST({c} AS STRING)"


def _typed_sql(name: str, dtype: T.DataType) -> tuple[int, str, str, str]:
    """``_typed`` as SQL text: one expression per part, so a whole table's
    unpivot is a single ``selectExpr`` (one driver round trip per table, not
    dozens per column)."""
    c, k = _ident(name), _kind(dtype)
    if k in (K_INT, K_BOOL):
        return k, f"CAST({c} AS BIGINT)", _NULL_D, _NULL_S
    if k == K_DATE:
        return k, f"CAST(unix_date({c}) AS BIGINT)", _NULL_D, _NULL_S
    if k == K_TS:
        return k, f"unix_micros({c})", _NULL_D, _NULL_S
    if k == K_DOUBLE:
        return k, _NULL_L, c, _NULL_S
    if k == K_FLOAT:
        return k, _NULL_L, f"CAST({c} AS DOUBLE)", _NULL_S
    return k, _NULL_L, _NULL_D, _text_sql(c, dtype)


def _display(kind: Column, l: Column, d: Column, s: Column) -> Column:
    """Text of a typed value as Spark casts the original type to text."""
    return (F.when(kind == K_INT, l.cast("string"))
            .when(kind == K_BOOL, F.when(l == 1, F.lit("true")).when(l == 0, F.lit("false")))
            .when(kind == K_DATE, F.date_from_unix_date(l.cast("int")).cast("string"))
            .when(kind == K_TS, F.timestamp_micros(l).cast("string"))
            .when(kind == K_DOUBLE, d.cast("string"))
            .when(kind == K_FLOAT, d.cast("float").cast("string"))
            .otherwise(s))


class Slots:
    """Every column of every source with a global integer id.  The grouped
    frames key on the id (an int) instead of table and column names; names
    are joined back at the end from this list (one row per column)."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, DataFrame]):
        self.spark, self.sources = spark, sources
        self.rows, self.base = [], {}
        for name, df in sources.items():
            self.base[name] = len(self.rows)
            for i, f in enumerate(df.schema.fields, start=1):
                self.rows.append((len(self.rows), name, f.name, i, _kind(f.dataType)))

    def frame(self) -> DataFrame:
        return metadata_frame(
            self.spark, self.rows, "col_id int, table_name string, column_name string, ordinal_position int, kind int")


def unpivot_typed(df: DataFrame, base: int, digest_over: int | None = None,
                  width: int = SAMPLE_WIDTH) -> DataFrame:
    """``(col_id, kind, l, d, s)``: one row per cell of ``df``, ids from
    ``base``, built by one ``stack`` generator over all columns.  The id and
    kind are literals of each stacked row, so no per-row lookup is needed.

    With ``digest_over`` texts longer than that many characters keep only
    their first ``width`` characters in ``s`` (for samples) and are told apart
    by their SHA-256 digest (``dg``, 32 bytes; NULL for all other values).
    Texts, heads and digests are computed by projections below the generator,
    so a nested value is turned into text once."""
    fields = df.schema.fields
    out = "col_id, kind, l, d, s" + (", dg" if digest_over else "")
    if not fields:
        types = "col_id int, kind int, l long, d double, s string" + (", dg binary" if digest_over else "")
        return df.sparkSession.createDataFrame([], types)
    typed = [_typed_sql(f.name, f.dataType) for f in fields]
    if not digest_over:
        rows = [", ".join([str(base + i), str(kind), l, d, txt]) for i, (kind, l, d, txt) in enumerate(typed)]
        return df.selectExpr(f"stack({len(fields)}, {', '.join(rows)}) AS ({out})")
    text, keyed, rows = [], [], []
    for i, (kind, l, d, txt) in enumerate(typed):
        if txt == _NULL_S:
            text.append(_ident(fields[i].name) + f" AS _v{i}")
            keyed.append(f"_v{i}")
            l, d = (e.replace(_ident(fields[i].name), f"_v{i}") for e in (l, d))
            rows.append(f"{base + i}, {kind}, {l}, {d}, {_NULL_S}, CAST(NULL AS BINARY)")
        else:
            text.append(f"{txt} AS _v{i}")
            big = f"length(_v{i}) > {int(digest_over)}"
            keyed += [f"CASE WHEN {big} THEN substring(_v{i}, 1, {int(width)}) ELSE _v{i} END AS _s{i}",
                      f"CASE WHEN {big} THEN unhex(sha2(_v{i}, 256)) END AS _g{i}"]
            rows.append(f"{base + i}, {kind}, {l}, {d}, _s{i}, _g{i}")
    return df.selectExpr(*text).selectExpr(*keyed).selectExpr(f"stack({len(fields)}, {', '.join(rows)}) AS ({out})")


def value_counts(slots: Slots, digest_over: int | None = None, width: int = SAMPLE_WIDTH) -> DataFrame:
    """``(col_id, kind, l, d, s, cnt)``: the shared grouped frame of all
    sources (plus ``dg`` with ``digest_over``)."""
    long = union_all([unpivot_typed(df, slots.base[name], digest_over, width) for name, df in slots.sources.items()])
    # ``kind`` depends on ``col_id`` only: it adds no groups, it is carried
    # so that samples can print each value as its original type would.  So
    # does the head of a long text on its digest: as a key and not as an
    # aggregate of text it keeps the count a hash aggregate.
    keys = ["col_id", "kind", "l", "d", "s"] + (["dg"] if digest_over else [])
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def _is_null() -> Column:
    return F.col("l").isNull() & F.col("d").isNull() & F.col("s").isNull()


def column_stats(counts: DataFrame) -> DataFrame:
    """Rows, NULLs and distinct values per column from ``value_counts``."""
    return counts.groupBy("col_id").agg(
        F.sum("cnt").alias("row_count"),
        F.coalesce(F.sum(F.when(_is_null(), F.col("cnt"))), F.lit(0)).cast("long").alias("null_count"),
        F.count(F.when(~_is_null(), F.lit(1))).alias("distinct_count"))


def null_percentage(nulls, rows) -> "F.Column":
    """A2: ``nulls / rows * 100`` rounded half-even to 2 places; NULL if no rows."""
    nulls = F.col(nulls) if isinstance(nulls, str) else nulls
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.when(rows > 0, F.bround(nulls.cast("double") / rows * 100, 2))


def samples_from_counts(counts: DataFrame, slots: Slots, n: int = SAMPLE_COUNT,
                        width: int = SAMPLE_WIDTH, sep: str = SAMPLE_SEPARATOR) -> DataFrame:
    """The ``n`` smallest distinct non-NULL heads (first ``width``
    characters of the value's text) per column, ascending, joined by
    ``sep``; blank -> NULL.  Output ``(col_id, sample_values)``."""
    # Heads are grouped with the largest count they cover.  Using ``cnt``
    # keeps this a consumer of ``counts`` (a bare distinct would let the
    # optimizer drop the grouped count and scan the sources a second time),
    # so the shuffle behind ``counts`` is reused by ``column_stats``.  NULL is
    # not filtered before the limit for the same reason: it sorts last, the
    # limit keeps n + 1, and collect_list skips it.
    text = F.substring(_display(F.col("kind"), F.col("l"), F.col("d"), F.col("s")), 1, width)
    heads = (counts.groupBy("col_id", text.alias("head"))
             .agg(F.max("cnt").alias("_top")))
    # (``_top`` breaks no ties: heads are unique per column.  It is in the
    # ordering so that column pruning cannot drop the aggregate.)
    w = Window.partitionBy("col_id").orderBy(F.col("head").asc_nulls_last(), "_top")
    top = heads.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n + 1)
    joined = F.array_join(F.slice(F.array_sort(F.collect_list("head")), 1, n), sep)
    return (top.groupBy("col_id")
            .agg(joined.alias("sample_values"))
            .withColumn("sample_values",
                        F.when(F.col("sample_values").rlike(r"^\s*$"), F.lit(None).cast("string"))
                        .otherwise(F.col("sample_values"))))


def _finish(slots: Slots, stats: DataFrame) -> DataFrame:
    """Drive the result from the column list (one row per column, so a
    zero-row table still yields its columns, with NULL statistics) and put
    the names back on the ids."""
    j = slots.frame().select("col_id", "table_name", "column_name", "ordinal_position") \
        .join(stats, "col_id", "left")
    has_rows = F.coalesce(F.col("row_count"), F.lit(0)) > 0
    return j.select(
        "table_name", "column_name", "ordinal_position",
        F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("row_count"),
        F.when(has_rows, F.col("null_count")).cast("long").alias("null_count"),
        null_percentage("null_count", "row_count").alias("null_percentage"),
        F.when(has_rows, F.col("distinct_count")).cast("long").alias("distinct_count"),
        *([c for c in stats.columns if c == "sample_values"]))


def _hll_sql(name: str, dtype: T.DataType) -> str:
    c = _ident(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN {c} = 0 THEN CAST(0.0 AS {dtype.simpleString()}) ELSE {c} END"
    if isinstance(dtype, (T.StringType, T.NumericType, T.BooleanType, T.DateType,
                          T.TimestampType, T.TimestampNTZType)):
        return c
    return _text_sql(c, dtype)


def _approx_stats(df: DataFrame, base: int, rsd: float) -> DataFrame:
    """One global aggregate per source (row count, non-NULL count and an
    HLL++ sketch per column), then one row per column."""
    fields = df.schema.fields
    aggs = [F.expr("count(1)").alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.expr(f"count({_ident(f.name)})").alias(f"_n{i}"))
        aggs.append(F.expr(f"approx_count_distinct({_hll_sql(f.name, f.dataType)}, {float(rsd)!r})").alias(f"_d{i}"))
    one = df.agg(*aggs)
    rows = ", ".join(f"{base + i}, _rows - _n{i}, CAST(_d{i} AS BIGINT)" for i in range(len(fields)))
    return one.selectExpr(f"stack({len(fields)}, {rows}) AS (col_id, null_count, distinct_count)",
                          "_rows AS row_count").select("col_id", "row_count", "null_count", "distinct_count")


def profile_all(spark: SparkSession, sources: Mapping[str, DataFrame], mode: str = "exact",
                with_samples: bool = False, rsd: float = 0.05,
                n: int = SAMPLE_COUNT, width: int = SAMPLE_WIDTH,
                digest_over: int = DIGEST_OVER) -> DataFrame:
    """Profile many tables into one ``(table_name, column_name, ...)`` frame.

    ``mode="exact"``: one grouped count over all sources together.
    ``mode="digest"``: the same, but texts longer than ``digest_over``
    characters are grouped by their SHA-256 digest, so long documents are
    not shuffled whole (counts are exact unless SHA-256 collides).
    ``mode="approx"``: HyperLogLog++ with relative error ``rsd``, one global
    aggregate per source and no wide shuffle; samples, when asked for, are
    still exact (they need the grouped frame)."""
    slots = Slots(spark, sources)
    empty = spark.createDataFrame([], "col_id int, row_count long, null_count long, distinct_count long")
    if not slots.rows:
        return _finish(slots, empty)
    if mode in ("exact", "digest") or with_samples:
        counts = value_counts(slots, digest_over if mode == "digest" else None, width)
    if mode in ("exact", "digest"):
        stats = column_stats(counts)
    elif mode == "approx":
        stats = union_all([empty, *(_approx_stats(df, slots.base[name], rsd) for name, df in sources.items()
                                    if df.schema.fields)])
    else:
        raise ValueError(f"unknown profile mode {mode!r}")
    if with_samples:
        # Every column with samples has a stats row, so a left join keeps all.
        stats = stats.join(samples_from_counts(counts, slots, n, width), "col_id", "left")
    return _finish(slots, stats)


def profile(df: DataFrame, table_name: str = "t", mode: str = "exact", with_samples: bool = False,
            rsd: float = 0.05) -> DataFrame:
    """A1-A4: NULL count and share, distinct count of every column of ``df``."""
    return profile_all(df.sparkSession, {table_name: df}, mode=mode, with_samples=with_samples, rsd=rsd)


def samples_all(sources: Mapping[str, DataFrame], n: int = SAMPLE_COUNT,
                width: int = SAMPLE_WIDTH) -> DataFrame:
    """A5 for many tables: ``(table_name, column_name, sample_values)``."""
    spark = next(iter(sources.values())).sparkSession
    slots = Slots(spark, sources)
    s = samples_from_counts(value_counts(slots), slots, n, width)
    return slots.frame().join(s, "col_id", "inner").select("table_name", "column_name", "sample_values")


def samples(df: DataFrame, table_name: str = "t", n: int = SAMPLE_COUNT,
            width: int = SAMPLE_WIDTH) -> DataFrame:
    """A5 on its own: ``(table_name, column_name, sample_values)``."""
    return samples_all({table_name: df}, n, width)


def attach_stats(columns: DataFrame, stats: DataFrame) -> DataFrame:
    """Put computed statistics on column rows; where a statistic was not
    computed (NULL), keep the stored value.  Column order of ``columns`` kept.
    Two rows of statistics for one column fail the job."""
    have = [c for c in ("null_percentage", "distinct_count", "sample_values") if c in stats.columns]
    s = guard_unique(stats.select("table_name", "column_name", *have), ["table_name", "column_name"], "statistics")[0].select(
        "table_name", "column_name", *[F.when(F.col("_present"), F.col(c)).alias(f"_new_{c}") for c in have])
    j = columns.join(s, ["table_name", "column_name"], "left")
    out = []
    for c in columns.columns:
        if f"_new_{c}" in j.columns:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)
