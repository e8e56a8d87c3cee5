"""Registered queries: reports."""

from __future__ import annotations

from lakeledger.operators.report import (
    OVERVIEW_COLUMNS, column_grid, coverage, export_nested, labels, layer_summary, layers, overview,
    search_tables, summary, table_header,
)
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.registry import register
from lakeledger.sources.schema import COLUMNS_SCHEMA, TABLES_SCHEMA

# ---- fixed values: the search the registered query runs ---------------------
SEARCH_LAYERS = ["brz", "slv", "gld", "other"]
SEARCH_TEXT = "high|t1[0-9]*7$"
# ---------------------------------------------------------------------------


def _cov_sql(src: str) -> str:
    return f"""
SELECT count(*) AS total, count(description) AS described,
       CAST(CASE WHEN count(*) > 0 THEN round_even(CAST(count(description) AS DOUBLE) / count(*) * 100, 0) ELSE 0 END AS INTEGER) AS coverage
FROM {src}"""


@register("coverage_tables", with_fx(["fx_tables"], _cov_sql("fx_tables")))
def q_coverage_tables(spark, sf_dir):
    return coverage(Fixtures(spark, sf_dir).fx_tables)


@register("coverage_columns", with_fx(["fx_columns"], _cov_sql("fx_columns")))
def q_coverage_columns(spark, sf_dir):
    return coverage(Fixtures(spark, sf_dir).fx_columns)


@register("summary", with_fx(["fx_tables", "fx_columns"], """
SELECT t.total AS total_tables, c.total AS total_columns,
       CAST(CASE WHEN t.total > 0 THEN round_even(CAST(t.described AS DOUBLE) / t.total * 100, 0) ELSE 0 END AS INTEGER) AS table_coverage,
       CAST(CASE WHEN c.total > 0 THEN round_even(CAST(c.described AS DOUBLE) / c.total * 100, 0) ELSE 0 END AS INTEGER) AS column_coverage
FROM (SELECT count(*) AS total, count(description) AS described FROM fx_tables) t,
     (SELECT count(*) AS total, count(description) AS described FROM fx_columns) c"""))
def q_summary(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return summary(fx.fx_tables, fx.fx_columns)


@register("layer_summary", with_fx(["fx_tables"], """
SELECT layer, count(table_name) AS table_count,
       CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows,
       round_even(avg(column_count), 1) AS avg_columns
FROM fx_tables WHERE layer IS NOT NULL GROUP BY layer"""))
def q_layer_summary(spark, sf_dir):
    return layer_summary(Fixtures(spark, sf_dir).fx_tables)


@register("layers", with_fx(["fx_tables"], "SELECT DISTINCT layer FROM fx_tables WHERE layer IS NOT NULL"))
def q_layers(spark, sf_dir):
    return layers(Fixtures(spark, sf_dir).fx_tables)


_LAYER_LIST = ", ".join(f"'{x}'" for x in SEARCH_LAYERS)


@register("search_tables", with_fx(["fx_tables"], f"""
SELECT * FROM fx_tables
WHERE layer IN ({_LAYER_LIST})
  AND (coalesce(regexp_matches(table_name, '{SEARCH_TEXT}', 'i'), false)
       OR coalesce(regexp_matches(description, '{SEARCH_TEXT}', 'i'), false))"""))
def q_search_tables(spark, sf_dir):
    return search_tables(Fixtures(spark, sf_dir).fx_tables, SEARCH_LAYERS, SEARCH_TEXT)


_ROWS = "coalesce(format('{:,}', row_count), '?')"


@register("table_header", with_fx(["fx_tables"], f"""
SELECT table_name, upper(layer) AS layer_tag, {_ROWS} AS rows_text,
       coalesce(CAST(column_count AS VARCHAR), '?') AS columns_text,
       coalesce(substring(scanned_at, 1, 19), 'Never') AS last_scanned
FROM fx_tables"""))
def q_table_header(spark, sf_dir):
    return table_header(Fixtures(spark, sf_dir).fx_tables)


@register("labels", with_fx(["fx_tables"], f"""
SELECT table_name, concat('[', upper(layer), '] ', table_name, ' (', {_ROWS}, ' rows)') AS label
FROM fx_tables"""))
def q_labels(spark, sf_dir):
    return labels(Fixtures(spark, sf_dir).fx_tables)


@register("overview", with_fx(["fx_tables"], f"SELECT {', '.join(OVERVIEW_COLUMNS)} FROM fx_tables"))
def q_overview(spark, sf_dir):
    return overview(Fixtures(spark, sf_dir).fx_tables)


@register("column_grid", with_fx(["fx_columns"], """
SELECT table_name, column_name, data_type, coalesce(is_primary_key, false) AS is_primary_key, is_nullable,
       null_percentage, distinct_count, sample_values, description, business_name
FROM fx_columns"""))
def q_column_grid(spark, sf_dir):
    return column_grid(Fixtures(spark, sf_dir).fx_columns)


def _export_sql() -> str:
    tcols = TABLES_SCHEMA.fieldNames()
    ccols = COLUMNS_SCHEMA.fieldNames()
    item = "{" + ", ".join(f"'{c}': {c}" for c in ccols) + "}"
    doc = "{" + ", ".join(f"'{c}': t.{c}" for c in tcols) + ", 'columns': coalesce(c.cols, [])}"
    return f"""
SELECT t.table_name, t.layer, CAST(coalesce(len(c.cols), 0) AS BIGINT) AS n_columns,
       coalesce(array_to_string(list_transform(c.cols, lambda x: x.column_name), ','), '') AS column_names,
       CAST(to_json({doc}) AS VARCHAR) AS doc
FROM fx_tables t LEFT JOIN (
  SELECT table_name, list({item} ORDER BY ordinal_position, column_name) AS cols
  FROM fx_columns GROUP BY table_name) c ON t.table_name = c.table_name"""


@register("export_nested", with_fx(["fx_tables", "fx_columns"], _export_sql()))
def q_export_nested(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return export_nested(fx.fx_tables, fx.fx_columns)


@register("coverage", with_fx(["fx_tables", "fx_columns"], f"""
SELECT 'tables' AS level, * FROM ({_cov_sql("fx_tables")})
UNION ALL
SELECT 'columns' AS level, * FROM ({_cov_sql("fx_columns")})"""))
def q_coverage(spark, sf_dir):
    from pyspark.sql import functions as F
    fx = Fixtures(spark, sf_dir)
    return (coverage(fx.fx_tables).select(F.lit("tables").alias("level"), "*")
            .unionByName(coverage(fx.fx_columns).select(F.lit("columns").alias("level"), "*")))
