"""Registered queries: scanning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeledger.functions.layers import detect_layer
from lakeledger.plans.driver_schema import DRIVER_COLUMNS
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.registry import NOW, register
from lakeledger.sources.scan import (
    keys_by_table, live_columns, live_tables, primary_keys, scan_columns, scan_tables, scan_totals,
)
from lakeledger.sources.tables import CATALOGUE_NAMES, DECLARED_KEYS, declared_key_metadata, driver_sources


def _sql_layer(expr: str) -> str:
    from lakeledger.functions.layers import LAYER_PREFIXES
    whens = " ".join(f"WHEN starts_with({expr}, '{p}_') THEN '{p}'" for p in LAYER_PREFIXES)
    return f"CASE {whens} ELSE 'other' END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- scan_tables ---------------------------------------------------------------
_SCAN_TABLES_SQL = " UNION ALL ".join(
    f"SELECT {_q(CATALOGUE_NAMES[t])} AS table_name, {_sql_layer(_q(CATALOGUE_NAMES[t]))} AS layer, "
    f"CAST(count(*) AS BIGINT) AS row_count, CAST({len(cols)} AS INTEGER) AS column_count, "
    f"{_q(NOW)} AS scanned_at FROM {t}"
    for t, cols in DRIVER_COLUMNS.items())


@register("scan_tables", _SCAN_TABLES_SQL)
def q_scan_tables(spark, sf_dir):
    return scan_tables(spark, driver_sources(spark, sf_dir), NOW)


# -- scan_columns --------------------------------------------------------------
def _scan_columns_rows() -> str:
    rows = []
    for t, cols in DRIVER_COLUMNS.items():
        keys = DECLARED_KEYS[t]
        for i, (c, ty) in enumerate(cols, start=1):
            rows.append(f"({_q(CATALOGUE_NAMES[t])}, {_q(c)}, {_q(ty)}, {i}, 'YES', "
                        f"{'true' if c in keys else 'false'})")
    return ",\n".join(rows)


_SCAN_COLUMNS_SQL = f"""
SELECT table_name, column_name, data_type, CAST(ordinal_position AS INTEGER) AS ordinal_position,
       is_nullable, is_primary_key,
       CAST(NULL AS DOUBLE) AS null_percentage, CAST(NULL AS BIGINT) AS distinct_count,
       CAST(NULL AS VARCHAR) AS sample_values, {_q(NOW)} AS scanned_at
FROM (VALUES {_scan_columns_rows()}) v(table_name, column_name, data_type, ordinal_position, is_nullable, is_primary_key)
"""


@register("scan_columns", _SCAN_COLUMNS_SQL)
def q_scan_columns(spark, sf_dir):
    sources = driver_sources(spark, sf_dir)
    cons, usage = declared_key_metadata(spark)
    return scan_columns(live_columns(spark, sources, ordered=False), primary_keys(cons, usage), NOW)


# -- key_columns (A12): key sets of the catalogued tables ----------------------
@register("key_columns", with_fx(["fx_columns_edited"], """
SELECT table_name, array_to_string(list_sort(list(column_name)), ',') AS key_columns, CAST(count(*) AS BIGINT) AS n_keys
FROM fx_columns_edited WHERE is_primary_key
GROUP BY table_name"""))
def q_key_columns(spark, sf_dir):
    cols = Fixtures(spark, sf_dir).fx_columns_edited
    k = keys_by_table(cols.filter(F.col("is_primary_key")).select("table_name", "column_name"))
    return k.select("table_name", F.array_join("key_columns", ",").alias("key_columns"),
                    F.size("key_columns").cast("long").alias("n_keys"))


# -- scan_totals (A14) ---------------------------------------------------------
@register("scan_totals", f"""
SELECT CAST({len(DRIVER_COLUMNS)} AS BIGINT) AS tables,
       CAST({sum(len(c) for c in DRIVER_COLUMNS.values())} AS BIGINT) AS columns""")
def q_scan_totals(spark, sf_dir):
    sources = driver_sources(spark, sf_dir)
    return scan_totals(scan_tables(spark, sources, NOW), live_columns(spark, sources))


# -- detect_layer (S4) ---------------------------------------------------------
@register("detect_layer", with_fx(["fx_names"], f"""
SELECT k, table_name, {_sql_layer('table_name')} AS layer FROM fx_names"""))
def q_detect_layer(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return fx.fx_names.select("k", "table_name", detect_layer("table_name").alias("layer"))


# -- live_tables (S1, P6) ------------------------------------------------------
@register("live_tables", with_fx(["fx_live_tables"], """
SELECT table_name FROM fx_live_tables
WHERE NOT starts_with(table_name, 'dd_') AND NOT starts_with(table_name, 'brz2')"""))
def q_live_tables(spark, sf_dir):
    return live_tables(Fixtures(spark, sf_dir).fx_live_tables)
