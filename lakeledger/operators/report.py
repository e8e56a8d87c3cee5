"""Reports over the catalogue.

All are projections or small aggregations.  Totals that combine two frames
union them and aggregate once (no join of one-row frames).  The nested
export groups column rows per table; a list is bounded by its table's width.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.sources.schema import select_existing

# ---- fixed values: the columns each view shows ------------------------------
OVERVIEW_COLUMNS = ["table_name", "layer", "row_count", "column_count",
                    "description", "business_owner", "scanned_at"]
GRID_COLUMNS = ["column_name", "data_type", "is_primary_key", "is_nullable",
                "null_percentage", "distinct_count", "sample_values",
                "description", "business_name"]
UNKNOWN = "?"
NEVER = "Never"
# ---------------------------------------------------------------------------


def _pct(part: Column, whole: Column) -> Column:
    """Integer percentage, half-even; 0 when ``whole`` is 0."""
    return F.when(whole > 0, F.bround(part.cast("double") / whole * 100, 0)).otherwise(F.lit(0.0)).cast("int")


def coverage(df: DataFrame, field: str = "description") -> DataFrame:
    """Rows, rows with ``field`` set ('' counts: Q14), percentage."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(field).alias("described")) \
             .select("total", "described", _pct(F.col("described"), F.col("total")).alias("coverage"))


def summary(tables: DataFrame, columns: DataFrame, field: str = "description") -> DataFrame:
    """R2: total tables, total columns and both coverages, one row, one job."""
    both = (tables.select(F.lit(1).alias("_t"), F.col(field).isNotNull().cast("int").alias("_d"))
            .unionByName(columns.select(F.lit(0).alias("_t"), F.col(field).isNotNull().cast("int").alias("_d"))))
    g = both.agg(F.sum("_t").alias("tt"), F.sum(F.col("_t") * F.col("_d")).alias("td"),
                 F.sum(1 - F.col("_t")).alias("ct"), F.sum((1 - F.col("_t")) * F.col("_d")).alias("cd"))
    tt, td, ct, cd = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tt", "td", "ct", "cd"))
    return g.select(tt.alias("total_tables"), ct.alias("total_columns"),
                    _pct(td, tt).alias("table_coverage"), _pct(cd, ct).alias("column_coverage"))


def layer_summary(df: DataFrame) -> DataFrame:
    """Per layer: tables, total rows (0 when all unknown: Q15), mean
    column count to one decimal; NULL layer left out; sorted by layer."""
    return (df.filter(F.col("layer").isNotNull())
            .groupBy("layer").agg(
                F.count("table_name").alias("table_count"),
                F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("total_rows"),
                F.bround(F.avg("column_count"), 1).alias("avg_columns"))
            .orderBy("layer"))


def layers(df: DataFrame) -> DataFrame:
    """The distinct layers, sorted."""
    return df.select("layer").filter(F.col("layer").isNotNull()).distinct().orderBy("layer")


def search_tables(df: DataFrame, layer_list: list[str] | None = None, text: str | None = None,
                  literal: bool = False, fields=("table_name", "description")) -> DataFrame:
    """Layer in ``layer_list`` (all when None), and, when ``text`` is
    given, a case-insensitive regex match on any of ``fields`` (NULL never
    matches).  ``literal`` quotes the text (Q17: Java and Python regex
    dialects differ; literal search is the same everywhere)."""
    out = df
    if layer_list is not None:
        out = out.filter(F.col("layer").isin(list(layer_list)))
    if text:
        pat = "(?iu)" + (re.escape(text) if literal else text)
        cond = None
        for f in fields:
            m = F.coalesce(F.col(f).rlike(pat), F.lit(False))
            cond = m if cond is None else (cond | m)
        out = out.filter(cond)
    return out


def _rows_text(rc: Column) -> Column:
    return F.coalesce(F.format_number(rc, 0), F.lit(UNKNOWN))


def table_header(df: DataFrame, name: str | None = None) -> DataFrame:
    """P5: header fields of one table (``name``) or of all: layer tag in
    capitals, rows with thousands separators, column count, scan time cut to
    19 characters; ``?`` / ``Never`` when unknown.  The point lookup is a
    filter on the key, pushed down to the scan."""
    src = df if name is None else df.filter(F.col("table_name") == name)
    return src.select(
        "table_name", F.upper("layer").alias("layer_tag"),
        _rows_text(F.col("row_count")).alias("rows_text"),
        F.coalesce(F.col("column_count").cast("string"), F.lit(UNKNOWN)).alias("columns_text"),
        F.coalesce(F.substring("scanned_at", 1, 19), F.lit(NEVER)).alias("last_scanned"))


def labels(df: DataFrame) -> DataFrame:
    """``[LAYER] name (1,234 rows)``, ``?`` rows when unknown."""
    return df.select("table_name", F.concat(
        F.lit("["), F.upper("layer"), F.lit("] "), F.col("table_name"), F.lit(" ("),
        _rows_text(F.col("row_count")), F.lit(" rows)")).alias("label"))


def overview(df: DataFrame) -> DataFrame:
    """The overview listing (the columns that exist)."""
    return select_existing(df, OVERVIEW_COLUMNS)


def column_grid(df: DataFrame, with_table: bool = True) -> DataFrame:
    """The column grid; the key flag as a plain boolean (NULL -> false)."""
    g = select_existing(df, (["table_name"] if with_table else []) + GRID_COLUMNS)
    if "is_primary_key" in g.columns:
        g = g.withColumn("is_primary_key", F.coalesce(F.col("is_primary_key").cast("boolean"), F.lit(False)))
    return g


def export_nested(tables: DataFrame, columns: DataFrame, as_json: bool = True) -> DataFrame:
    """Each table with its column rows as an ordered ``columns``
    array (``[]`` when it has none); columns without a table row are left
    out; NULL fields are kept; NaN becomes NULL (Q20).

    Output ``table_name, layer, n_columns, column_names, doc`` where ``doc``
    is the table's JSON document (with ``as_json``)."""
    def no_nan(df: DataFrame) -> DataFrame:
        return df.select([F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                          if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                          for f in df.schema.fields])

    cols = no_nan(columns)
    item = F.struct(*[F.col(c) for c in cols.columns])
    if not _has_map(cols.schema):
        # Sort (ordinal, name, item) structs with the built-in ordering (no
        # comparator call per comparison), then keep the item.
        keyed = F.struct(F.col("ordinal_position").alias("_o"), F.col("column_name").alias("_n"), item.alias("_i"))
        per_table = cols.groupBy("table_name").agg(F.sort_array(F.collect_list(keyed)).alias("_cols"))
        ordered = F.col("_cols._i")
    else:  # maps have no ordering: compare the two keys explicitly
        per_table = cols.groupBy("table_name").agg(F.collect_list(item).alias("_cols"))
        ordered = F.array_sort("_cols", lambda a, b: F.when(
            a["ordinal_position"] < b["ordinal_position"], -1).when(
            a["ordinal_position"] > b["ordinal_position"], 1).when(
            a["column_name"] < b["column_name"], -1).when(
            a["column_name"] > b["column_name"], 1).otherwise(0))
    t = no_nan(tables)
    j = t.join(per_table.select("table_name", ordered.alias("columns")), "table_name", "left")
    arr = F.coalesce(F.col("columns"), F.array().cast(T.ArrayType(cols.select(item).schema[0].dataType)))
    out = j.select(*t.columns, arr.alias("columns"))
    res = out.select("table_name", "layer", F.size("columns").cast("long").alias("n_columns"),
                     F.array_join(F.col("columns.column_name"), ",").alias("column_names"),
                     *([F.to_json(F.struct(*[F.col(c) for c in out.columns]),
                                  {"ignoreNullFields": "false"}).alias("doc")] if as_json else []))
    return res


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return False


def write_export(doc_frame: DataFrame, path: str, compression: str | None = None) -> None:
    """Write the export as JSON lines ordered by (layer, table_name).

    ``compression`` (``gzip``, ...): documents repeat their field names, so
    they shrink many times; ``read_export`` reads either form."""
    doc_frame.orderBy("layer", "table_name").select(F.col("doc").alias("value")) \
        .write.mode("overwrite").text(path, compression=compression)


def export_schema(tables: T.StructType, columns: T.StructType) -> T.StructType:
    """The schema of exported documents: a table's fields and its ``columns`` array."""
    return T.StructType([*tables.fields, T.StructField("columns", T.ArrayType(T.StructType(columns.fields)))])


def read_export(spark: SparkSession, path: str, tables: T.StructType, columns: T.StructType) -> DataFrame:
    """S12 back: the documents of ``write_export`` as table rows with a nested ``columns`` array.

    A line that is no such document fails the job."""
    return spark.read.schema(export_schema(tables, columns)).option("mode", "FAILFAST").json(path)
