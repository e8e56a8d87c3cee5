"""Catalogue schemas and schema fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()

# ---- fixed values: the catalogue's fields, names and types ------------------
# Table rows, key ``table_name``.
TABLES_SCHEMA = T.StructType([
    T.StructField("table_name", S, False),
    T.StructField("layer", S, False),
    T.StructField("row_count", L, True),
    T.StructField("column_count", I, True),
    T.StructField("description", S, True),
    T.StructField("business_owner", S, True),
    T.StructField("source_system", S, True),
    T.StructField("refresh_frequency", S, True),
    T.StructField("tags", S, True),          # comma-separated text
    T.StructField("scanned_at", S, False),   # ISO text
    T.StructField("updated_at", S, True),
    T.StructField("updated_by", S, True),
])
TABLE_KEYS = ["table_name"]
# Fields a person writes; a re-scan keeps them.
TABLE_USER_FIELDS = ["description", "business_owner", "source_system",
                     "refresh_frequency", "tags"]

# Column rows, key ``(table_name, column_name)``.
COLUMNS_SCHEMA = T.StructType([
    T.StructField("table_name", S, False),
    T.StructField("column_name", S, False),
    T.StructField("data_type", S, False),
    T.StructField("ordinal_position", I, False),
    T.StructField("is_nullable", S, True),   # 'YES' / 'NO'
    T.StructField("is_primary_key", B, True),
    T.StructField("description", S, True),
    T.StructField("business_name", S, True),
    T.StructField("sample_values", S, True),  # 'a | b | c'
    T.StructField("null_percentage", D, True),
    T.StructField("distinct_count", L, True),
    T.StructField("scanned_at", S, False),
    T.StructField("updated_at", S, True),
    T.StructField("updated_by", S, True),
])
COLUMN_KEYS = ["table_name", "column_name"]
COLUMN_USER_FIELDS = ["description", "business_name"]
COLUMN_STAT_FIELDS = ["null_percentage", "distinct_count", "sample_values"]
# ---------------------------------------------------------------------------

# Shape of the edit log: one row per saved field value.
EDITS_SCHEMA = T.StructType([
    T.StructField("table_name", S, False),
    T.StructField("column_name", S, True),   # NULL = table-level edit
    T.StructField("field", S, False),
    T.StructField("value", S, True),
    T.StructField("edited_at", T.TimestampNTZType(), False),
    T.StructField("seq", L, False),
])


def metadata_frame(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A small frame built on the driver from metadata (schemas, declared
    keys).  It carries no join hint: Spark knows its size in bytes."""
    return spark.createDataFrame(rows, schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name as a balanced tree: a left-deep chain over thousands of
    tables would be analysed again at every step."""
    while len(frames) > 1:
        pairs = zip(frames[::2], frames[1::2])
        frames = [a.unionByName(b) for a, b in pairs] + frames[len(frames) // 2 * 2:]
    return frames[0]


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    have = set(df.columns)
    return df.select([c for c in cols if c in have])


def _sources(df: DataFrame, schema: T.StructType, case_insensitive: bool) -> dict[str, str]:
    """Source column of each target field that has one; a name in the same case comes before others."""
    norm = (lambda s: s.lower()) if case_insensitive else (lambda s: s)
    by_name = {norm(c): c for c in reversed(df.columns)}
    same = set(df.columns)
    return {f.name: f.name if f.name in same else by_name[norm(f.name)] for f in schema.fields if norm(f.name) in by_name}


def align_to(df: DataFrame, schema: T.StructType, case_insensitive: bool = True) -> DataFrame:
    """Fit ``df`` to ``schema``: same names and order, cast to the target
    types; target columns the source lacks come as typed NULL; source columns
    the target lacks are dropped.  Names match ignoring case by default.  A
    value that does not cast fails the job; ``fit`` sets such rows aside."""
    by_name = _sources(df, schema, case_insensitive)
    return df.select([(F.col(f"`{by_name[f.name]}`") if f.name in by_name else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in schema.fields])


def fit(df: DataFrame, schema: T.StructType, keys: list[str], case_insensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """P2 with rejects: ``(fitted, rejects)``.

    ``fitted`` is what ``align_to`` gives, of the rows that fit.  A row with
    a value that does not cast to its target type, or without a value in one
    of ``keys``, is no part of it: each such field is a row of ``rejects``,
    ``(keys..., field, value, target_type)``, the keys as text as they came
    and the value as text.  Every source row is in one of the two."""
    by_name = _sources(df, schema, case_insensitive)
    fitted, faults = [], []
    for f in schema.fields:
        if f.name not in by_name:
            fitted.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        source = F.col(f"`{by_name[f.name]}`")
        value = source.try_cast(f.dataType)
        fault = source.isNotNull() & value.isNull()
        fitted.append(value.alias(f.name))
        faults.append(F.when(fault | (source.isNull() if f.name in keys else F.lit(False)), F.struct(
            F.lit(f.name).alias("field"), source.cast("string").alias("value"), F.lit(f.dataType.simpleString()).alias("target_type"))))
    missing = [k for k in keys if k not in by_name]
    if missing:
        raise ValueError(f"the source lacks the keys {missing}")
    as_came = [F.col(f"`{by_name[k]}`").cast("string").alias(f"_k_{k}") for k in keys]
    both = df.select(*fitted, *as_came, F.array_compact(F.array(*faults)).alias("_faults"))
    return (both.filter(F.size("_faults") == 0).select(schema.fieldNames()),
            both.filter(F.size("_faults") > 0).select(*[F.col(f"_k_{k}").alias(k) for k in keys], F.inline("_faults")))


def restrict_to_target(schema: T.StructType, target_columns: list[str]) -> T.StructType:
    """Keep only the fields the target really has (compared in lower case)."""
    have = {c.lower() for c in target_columns}
    return T.StructType([f for f in schema.fields if f.name.lower() in have])
