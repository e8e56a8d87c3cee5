"""Registered queries: reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeledger.operators.edits import collapse_edits
from lakeledger.operators.reconcile import (
    delete_stale, orphan_columns, preserve_columns, preserve_tables, stale_columns,
    stale_report, stale_tables, update_fields, upsert,
)
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.registry import NOW, register
from lakeledger.sources.schema import COLUMN_KEYS, COLUMNS_SCHEMA, TABLE_KEYS, TABLES_SCHEMA
from lakeledger.sources.scan import live_tables

_T = TABLES_SCHEMA.fieldNames()
_C = COLUMNS_SCHEMA.fieldNames()

# -- preserve ------------------------------------------------------------------
_PRESERVE_TABLES = """
SELECT s.table_name, s.layer, s.row_count, s.column_count,
       nullif(t.description, '') AS description, nullif(t.business_owner, '') AS business_owner,
       nullif(t.source_system, '') AS source_system, nullif(t.refresh_frequency, '') AS refresh_frequency,
       nullif(t.tags, '') AS tags, s.scanned_at,
       nullif(t.updated_at, '') AS updated_at, nullif(t.updated_by, '') AS updated_by
FROM fx_scan_tables s LEFT JOIN fx_tables t ON s.table_name = t.table_name"""

_PRESERVE_COLUMNS = """
SELECT s.table_name, s.column_name, s.data_type, s.ordinal_position, s.is_nullable,
       CASE WHEN coalesce(c.is_primary_key, false) THEN true ELSE s.is_primary_key END AS is_primary_key,
       nullif(c.description, '') AS description, nullif(c.business_name, '') AS business_name,
       CAST(NULL AS VARCHAR) AS sample_values, CAST(NULL AS DOUBLE) AS null_percentage,
       CAST(NULL AS BIGINT) AS distinct_count, s.scanned_at,
       nullif(c.updated_at, '') AS updated_at, nullif(c.updated_by, '') AS updated_by
FROM fx_scan_columns s LEFT JOIN fx_columns c
  ON s.table_name = c.table_name AND s.column_name = c.column_name"""


@register("preserve_tables", with_fx(["fx_scan_tables", "fx_tables"], _PRESERVE_TABLES))
def q_preserve_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return preserve_tables(fx.fx_scan_tables, fx.fx_tables)


@register("preserve_columns", with_fx(["fx_scan_columns", "fx_columns"], _PRESERVE_COLUMNS))
def q_preserve_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return preserve_columns(fx.fx_scan_columns, fx.fx_columns)


# -- upsert --------------------------------------------------------------------
def _upsert_sql(target: str, src: str, keys: list[str], cols: list[str]) -> str:
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    sel = ", ".join(f"CASE WHEN s.{keys[0]} IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in cols)
    return f"SELECT {sel} FROM {target} t FULL JOIN {src} s ON {on}"


@register("upsert_tables", with_fx(["fx_scan_tables", "fx_tables"],
                                   _upsert_sql("fx_tables", "src", TABLE_KEYS, _T),
                                   [("src", _PRESERVE_TABLES)]))
def q_upsert_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return upsert(fx.fx_tables, preserve_tables(fx.fx_scan_tables, fx.fx_tables), TABLE_KEYS)


@register("upsert_columns", with_fx(["fx_scan_columns", "fx_columns"],
                                    _upsert_sql("fx_columns", "src", COLUMN_KEYS, _C),
                                    [("src", _PRESERVE_COLUMNS)]))
def q_upsert_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return upsert(fx.fx_columns, preserve_columns(fx.fx_scan_columns, fx.fx_columns), COLUMN_KEYS)


# -- stale records ---------------------------------------------------------------
_LIVE = """
SELECT table_name FROM fx_live_tables
WHERE NOT starts_with(table_name, 'dd_') AND NOT starts_with(table_name, 'brz2')"""


def _live(fx):
    return live_tables(fx.fx_live_tables)


@register("stale_tables", with_fx(["fx_tables", "fx_live_tables"], """
SELECT table_name FROM fx_tables WHERE table_name NOT IN (SELECT table_name FROM live)""", [("live", _LIVE)]))
def q_stale_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return stale_tables(fx.fx_tables, _live(fx))


_STALE_COLS = """
SELECT table_name, column_name, ordinal_position FROM fx_columns
WHERE table_name NOT IN (SELECT table_name FROM live)"""


@register("stale_columns", with_fx(["fx_columns", "fx_live_tables"], "SELECT * FROM sc",
                                   [("live", _LIVE), ("sc", _STALE_COLS)]))
def q_stale_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return stale_columns(fx.fx_columns, _live(fx))


_ORPHANS = """
SELECT * FROM sc WHERE table_name NOT IN (
  SELECT table_name FROM fx_tables WHERE table_name NOT IN (SELECT table_name FROM live))"""


@register("orphan_columns", with_fx(["fx_tables", "fx_columns", "fx_live_tables"], "SELECT * FROM orph",
                                    [("live", _LIVE), ("sc", _STALE_COLS), ("orph", _ORPHANS)]))
def q_orphan_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    live = _live(fx)
    return orphan_columns(stale_columns(fx.fx_columns, live), stale_tables(fx.fx_tables, live))


@register("stale_report", with_fx(["fx_tables", "fx_columns", "fx_live_tables"], """
SELECT table_name, CAST(count(*) AS BIGINT) AS n_columns,
       string_agg(column_name, ', ' ORDER BY ordinal_position, column_name) AS column_list
FROM orph GROUP BY table_name""", [("live", _LIVE), ("sc", _STALE_COLS), ("orph", _ORPHANS)]))
def q_stale_report(spark, sf_dir):
    return stale_report(q_orphan_columns(spark, sf_dir))


@register("delete_stale_tables", with_fx(["fx_tables", "fx_live_tables"], """
SELECT * FROM fx_tables WHERE table_name IN (SELECT table_name FROM live)""", [("live", _LIVE)]))
def q_delete_stale_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return delete_stale(fx.fx_tables, fx.fx_columns, _live(fx))[0]


@register("delete_stale_columns", with_fx(["fx_columns", "fx_live_tables"], """
SELECT * FROM fx_columns WHERE table_name IN (SELECT table_name FROM live)""", [("live", _LIVE)]))
def q_delete_stale_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return delete_stale(fx.fx_tables, fx.fx_columns, _live(fx))[1]


# -- update_fields: direct writes of the last description edit per table --------
_DESC_EDITS = """
SELECT table_name, arg_max_null(value, (edited_at, seq)) AS description
FROM fx_edits WHERE field = 'description' GROUP BY table_name"""


@register("update_fields", with_fx(["fx_tables", "fx_edits"], f"""
SELECT t.table_name, t.layer, t.row_count, t.column_count,
       CASE WHEN e.table_name IS NOT NULL THEN e.description ELSE t.description END AS description,
       t.business_owner, t.source_system, t.refresh_frequency, t.tags, t.scanned_at,
       CASE WHEN e.table_name IS NOT NULL THEN '{NOW}' ELSE t.updated_at END AS updated_at,
       t.updated_by
FROM fx_tables t LEFT JOIN ed e ON t.table_name = e.table_name""", [("ed", _DESC_EDITS)]))
def q_update_fields(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    # Local-mode writes keep NULL and '' (they clear the field).
    last = collapse_edits(fx.fx_edits.filter(F.col("field") == "description"), ["table_name"],
                          drop="none")
    return update_fields(fx.fx_tables, last.select("table_name", F.col("value").alias("description")),
                         ["table_name"], NOW)


# -- refresh_tables: scan the driver tables and merge them into the catalogue --
def _refresh_sql() -> str:
    from lakeledger.plans.q_scan import _SCAN_TABLES_SQL
    src = f"""
SELECT s.table_name, s.layer, s.row_count, s.column_count,
       nullif(t.description, '') AS description, nullif(t.business_owner, '') AS business_owner,
       nullif(t.source_system, '') AS source_system, nullif(t.refresh_frequency, '') AS refresh_frequency,
       nullif(t.tags, '') AS tags, s.scanned_at,
       nullif(t.updated_at, '') AS updated_at, nullif(t.updated_by, '') AS updated_by
FROM ({_SCAN_TABLES_SQL}) s LEFT JOIN fx_tables t ON s.table_name = t.table_name"""
    return with_fx(["fx_tables"], _upsert_sql("fx_tables", "src", TABLE_KEYS, _T), [("src", src)])


@register("refresh_tables", _refresh_sql())
def q_refresh_tables(spark, sf_dir):
    from lakeledger.sources.scan import scan_tables
    from lakeledger.sources.tables import driver_sources
    fx = Fixtures(spark, sf_dir)
    scanned = scan_tables(spark, driver_sources(spark, sf_dir), NOW)
    return upsert(fx.fx_tables, preserve_tables(scanned, fx.fx_tables), TABLE_KEYS)
