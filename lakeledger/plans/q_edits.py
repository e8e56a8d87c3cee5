"""Registered queries: the edit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeledger.operators.edits import (
    apply_edits, collapse_edits, consume_edits, diff_count, diff_rows, edited_fields, overlay, pending,
)
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.registry import NOW, register
from lakeledger.sources.schema import COLUMN_KEYS, COLUMNS_SCHEMA, TABLE_KEYS, TABLES_SCHEMA

_T = TABLES_SCHEMA.fieldNames()
_C = COLUMNS_SCHEMA.fieldNames()
# ---- fixed values ----------------------------------------------------------
# The queue was applied at this moment; edits saved after it stay queued.
APPLIED_AT = "2024-01-08 00:00:00"
# ---------------------------------------------------------------------------

_ISO = ("CASE WHEN microsecond({t}) % 1000000 = 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END")


def _keep(drop: str) -> str:
    return "value IS NOT NULL AND value <> ''" if drop == "falsy" else "value IS NOT NULL"


def _collapse_sql(log: str, keys: list[str], drop: str) -> str:
    k = ", ".join(keys)
    return f"""
SELECT {k}, field, arg_max(value, (edited_at, seq)) AS value,
       max(edited_at) AS edited_at, arg_max(seq, (edited_at, seq)) AS seq
FROM {log} WHERE {_keep(drop)} GROUP BY {k}, field"""


@register("collapse_edits", with_fx(["fx_edits"], _collapse_sql("fx_edits", TABLE_KEYS, "falsy")))
def q_collapse_edits(spark, sf_dir):
    return collapse_edits(Fixtures(spark, sf_dir).fx_edits, TABLE_KEYS, drop="falsy")


@register("collapse_column_edits", with_fx(["fx_column_edits"], _collapse_sql("fx_column_edits", COLUMN_KEYS, "null")))
def q_collapse_column_edits(spark, sf_dir):
    return collapse_edits(Fixtures(spark, sf_dir).fx_column_edits, COLUMN_KEYS, drop="null")


@register("edited_fields", with_fx(["fx_edits", "fx_column_edits"], """
SELECT DISTINCT field FROM (SELECT field FROM fx_edits UNION ALL SELECT field FROM fx_column_edits)"""))
def q_edited_fields(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return edited_fields(fx.fx_edits.select("field").unionByName(fx.fx_column_edits.select("field")))


# -- wide latest edits, as SQL -------------------------------------------------
def _wide_sql(log: str, keys: list[str], fields: list[str], drop: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"l.{x} = c.{x}" for x in keys)
    pick = ", ".join(f"max(CASE WHEN c.field = '{f}' THEN c.value END) AS {f}" for f in fields)
    lk = ", ".join(f"l.{x}" for x in keys)
    return f"""
SELECT {lk}, l.last_edit, l.has_kept, {pick}
FROM (SELECT {k}, max(edited_at) AS last_edit, bool_or({_keep(drop)}) AS has_kept FROM {log} GROUP BY {k}) l
LEFT JOIN ({_collapse_sql(log, keys, drop)}) c ON {on}
GROUP BY {lk}, l.last_edit, l.has_kept"""


_TF = [c for c in _T if c not in ("table_name", "updated_at")]
_CF = [c for c in _C if c not in ("table_name", "column_name", "updated_at")]


def _overlay_sql(target: str, log: str, keys: list[str], fields: list[str], cols: list[str], drop: str) -> str:
    on = " AND ".join(f"t.{x} = w.{x}" for x in keys)
    sel = []
    for c in cols:
        if c in fields:
            sel.append(f"coalesce(CAST(w.{c} AS {_sqltype(c)}), t.{c}) AS {c}")
        elif c == "updated_at":
            sel.append(f"CASE WHEN w.{keys[0]} IS NOT NULL THEN {_ISO.format(t='w.last_edit')} ELSE t.updated_at END AS updated_at")
        else:
            sel.append(f"t.{c}")
    return f"SELECT {', '.join(sel)} FROM {target} t LEFT JOIN ({_wide_sql(log, keys, fields, drop)}) w ON {on}"


def _sqltype(c: str) -> str:
    return {"row_count": "BIGINT", "column_count": "INTEGER", "ordinal_position": "INTEGER",
            "is_primary_key": "BOOLEAN", "null_percentage": "DOUBLE", "distinct_count": "BIGINT"}.get(c, "VARCHAR")


@register("overlay_tables", with_fx(["fx_tables", "fx_edits"],
                                    _overlay_sql("fx_tables", "fx_edits", TABLE_KEYS, _TF, _T, "falsy")))
def q_overlay_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return overlay(fx.fx_tables, fx.fx_edits, TABLE_KEYS, drop="falsy")


@register("overlay_columns", with_fx(["fx_columns", "fx_column_edits"],
                                     _overlay_sql("fx_columns", "fx_column_edits", COLUMN_KEYS, _CF, _C, "null")))
def q_overlay_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return overlay(fx.fx_columns, fx.fx_column_edits, COLUMN_KEYS, drop="null")


def _apply_sql(target: str, log: str, keys: list[str], fields: list[str], cols: list[str], drop: str) -> str:
    on = " AND ".join(f"t.{x} = w.{x}" for x in keys)
    sel = []
    for c in cols:
        if c in fields:
            sel.append(f"coalesce(CAST(w.{c} AS {_sqltype(c)}), t.{c}) AS {c}")
        elif c == "updated_at":
            sel.append(f"CASE WHEN w.{keys[0]} IS NOT NULL THEN '{NOW}' ELSE t.updated_at END AS updated_at")
        else:
            sel.append(f"t.{c}")
    return (f"SELECT {', '.join(sel)} FROM {target} t LEFT JOIN "
            f"(SELECT * FROM ({_wide_sql(log, keys, fields, drop)}) WHERE has_kept) w ON {on}")


@register("apply_edits_tables", with_fx(["fx_tables", "fx_edits"],
                                        _apply_sql("fx_tables", "fx_edits", TABLE_KEYS, _TF, _T, "falsy")))
def q_apply_edits_tables(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return apply_edits(fx.fx_tables, fx.fx_edits, TABLE_KEYS, NOW, drop="falsy")


@register("apply_edits_columns", with_fx(["fx_columns", "fx_column_edits"],
                                         _apply_sql("fx_columns", "fx_column_edits", COLUMN_KEYS, _CF, _C, "null")))
def q_apply_edits_columns(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return apply_edits(fx.fx_columns, fx.fx_column_edits, COLUMN_KEYS, NOW, drop="null")


@register("pending_edits", with_fx(["fx_edits", "fx_column_edits"], """
SELECT (SELECT count(DISTINCT table_name) FROM fx_edits) AS pending_tables,
       (SELECT count(*) FROM (SELECT DISTINCT table_name, column_name FROM fx_column_edits)) AS pending_columns"""))
def q_pending_edits(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return pending(fx.fx_edits, fx.fx_column_edits)


@register("consume_edits", with_fx(["fx_edits"], f"""
SELECT * FROM fx_edits WHERE edited_at > TIMESTAMP '{APPLIED_AT}'"""))
def q_consume_edits(spark, sf_dir):
    # seq and edited_at are not in the same order: later edits with a smaller seq stay
    log = Fixtures(spark, sf_dir).fx_edits
    return consume_edits(log, log.filter(F.col("edited_at") <= F.lit(APPLIED_AT).cast("timestamp_ntz")))


_DIFF = """
SELECT b.table_name, b.column_name, 'description' AS field, b.description AS old_value, a.description AS new_value
FROM fx_columns b JOIN fx_columns_edited a USING (table_name, column_name)
WHERE coalesce(b.description, '') <> coalesce(a.description, '')
UNION ALL
SELECT b.table_name, b.column_name, 'business_name', b.business_name, a.business_name
FROM fx_columns b JOIN fx_columns_edited a USING (table_name, column_name)
WHERE coalesce(b.business_name, '') <> coalesce(a.business_name, '')
UNION ALL
SELECT b.table_name, b.column_name, 'is_primary_key',
       CASE WHEN coalesce(b.is_primary_key, false) THEN '1' ELSE '0' END,
       CASE WHEN coalesce(a.is_primary_key, false) THEN '1' ELSE '0' END
FROM fx_columns b JOIN fx_columns_edited a USING (table_name, column_name)
WHERE coalesce(b.is_primary_key, false) <> coalesce(a.is_primary_key, false)"""


def _diff(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return diff_rows(fx.fx_columns, fx.fx_columns_edited, COLUMN_KEYS,
                     ["description", "business_name"], ["is_primary_key"])


@register("diff_columns", with_fx(["fx_columns", "fx_columns_edited"], _DIFF))
def q_diff_columns(spark, sf_dir):
    return _diff(spark, sf_dir)


@register("diff_count", with_fx(["fx_columns", "fx_columns_edited"], f"""
SELECT count(*) AS changed_rows FROM (SELECT DISTINCT table_name, column_name FROM ({_DIFF}))"""))
def q_diff_count(spark, sf_dir):
    return diff_count(_diff(spark, sf_dir), COLUMN_KEYS)
