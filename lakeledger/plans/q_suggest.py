"""Registered queries: suggestions."""

from __future__ import annotations

from lakeledger.functions.layers import REFRESH_FREQUENCIES
from lakeledger.operators.suggest import (
    COLUMN_PROMPT_TAIL, FREQUENCY_DOMAIN, PROMPT_COLUMN_LIMIT, TABLE_PROMPT_INTRO, TABLE_PROMPT_LAYER_HINT,
    TABLE_PROMPT_TAIL, TABLE_REPLY_FIELDS, column_prompts, explode_replies, fill_from, parse_replies, prefer,
    table_prompts,
)
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.q_scan import _q
from lakeledger.plans.registry import register

_HAS_SAMPLE = "sample_values IS NOT NULL AND sample_values <> ''"


def _prompt_sql(line: str, head_mid: str, tail: str, limit: int | None) -> str:
    lim = f"WHERE rn <= {limit}" if limit else ""
    return f"""
SELECT t.table_name,
       concat({_q(TABLE_PROMPT_INTRO + chr(10) + chr(10) + 'Table: ')}, t.table_name, {head_mid},
              coalesce(l.lines, ''), {_q(chr(10) + chr(10) + tail)}) AS prompt
FROM fx_tables t LEFT JOIN (
  SELECT table_name, string_agg(line, chr(10) ORDER BY ordinal_position, column_name) AS lines
  FROM (SELECT table_name, ordinal_position, column_name, {line} AS line,
               row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position, column_name) AS rn
        FROM fx_columns_profiled) {lim}
  GROUP BY table_name) l ON t.table_name = l.table_name"""


_TABLE_LINE = (f"concat(coalesce(column_name, '?'), ' (', coalesce(data_type, '?'), ')', "
               f"CASE WHEN {_HAS_SAMPLE} THEN concat(' - samples: ', sample_values) ELSE '' END)")
_TABLE_MID = (f"{_q(chr(10) + 'Layer: ')}, coalesce(t.layer, 'None'), "
              f"{_q(' ' + TABLE_PROMPT_LAYER_HINT + chr(10) + 'Columns:' + chr(10))}")


@register("table_prompts", with_fx(["fx_tables", "fx_columns_profiled"],
                                   _prompt_sql(_TABLE_LINE, _TABLE_MID, TABLE_PROMPT_TAIL, PROMPT_COLUMN_LIMIT)))
def q_table_prompts(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return table_prompts(fx.fx_tables, fx.fx_columns_profiled)


_COLUMN_LINE = (f"concat_ws(' | ', coalesce(column_name, '?'), coalesce(data_type, '?'), "
                f"CASE WHEN {_HAS_SAMPLE} THEN concat('samples: ', sample_values) END, "
                f"CASE WHEN null_percentage IS NOT NULL AND NOT isnan(null_percentage) "
                f"THEN concat('null: ', CAST(null_percentage AS VARCHAR), '%') END)")
_COLUMN_MID = f"' (layer: ', coalesce(t.layer, 'None'), {_q(')' + chr(10) + 'Columns:' + chr(10))}"


@register("column_prompts", with_fx(["fx_tables", "fx_columns_profiled"],
                                    _prompt_sql(_COLUMN_LINE, _COLUMN_MID, COLUMN_PROMPT_TAIL, None)))
def q_column_prompts(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return column_prompts(fx.fx_tables, fx.fx_columns_profiled)


_REPLY_TEXT = """CASE WHEN contains(response, '```')
  THEN regexp_replace(regexp_replace(split_part(response, '```', 2), '^json', ''), '^\\s+|\\s+$', '', 'g')
  ELSE response END"""
_IS_OBJ = "CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END"
_PARSED = f"""
SELECT table_name,
       {', '.join(f"CASE WHEN {_IS_OBJ} THEN json_extract_string(t, '$.{f}') END AS {f}" for f in TABLE_REPLY_FIELDS)},
       NOT ({_IS_OBJ}) AS is_bad
FROM (SELECT table_name, {_REPLY_TEXT} AS t FROM fx_ai_tables)"""


@register("parse_replies", with_fx(["fx_ai_tables"], _PARSED))
def q_parse_replies(spark, sf_dir):
    return parse_replies(Fixtures(spark, sf_dir).fx_ai_tables)


_EXPLODED = f"""
SELECT table_name, column_name,
       arg_max_null(description, i) AS description, arg_max_null(business_name, i) AS business_name,
       arg_max(has_description, i) AS has_description, arg_max(has_business_name, i) AS has_business_name
FROM (
  SELECT table_name, i, json_extract_string(e, '$.column_name') AS column_name,
         json_extract_string(e, '$.description') AS description,
         json_extract_string(e, '$.business_name') AS business_name,
         json_exists(e, '$.description') AS has_description,
         json_exists(e, '$.business_name') AS has_business_name
  FROM (SELECT table_name, i, json_extract(t, concat('$[', CAST(i AS VARCHAR), ']')) AS e
        FROM (SELECT table_name, t, unnest(range(CAST(json_array_length(t) AS BIGINT))) AS i
              FROM (SELECT table_name, {_REPLY_TEXT} AS t FROM fx_ai_columns)
              WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'ARRAY' ELSE false END)))
WHERE column_name IS NOT NULL
GROUP BY table_name, column_name"""


@register("explode_replies", with_fx(["fx_ai_columns"], _EXPLODED))
def q_explode_replies(spark, sf_dir):
    return explode_replies(Fixtures(spark, sf_dir).fx_ai_columns)


def _fill(f: str) -> str:
    return (f"CASE WHEN c.{f} IS NULL AND s.column_name IS NOT NULL "
            f"THEN (CASE WHEN s.has_{f} THEN s.{f} ELSE '' END) ELSE c.{f} END AS {f}")


@register("fill_columns", with_fx(["fx_columns", "fx_ai_columns"], f"""
SELECT c.table_name, c.column_name, {_fill('description')}, {_fill('business_name')}
FROM fx_columns c LEFT JOIN s ON c.table_name = s.table_name AND c.column_name = s.column_name""",
                                  [("s", _EXPLODED)]))
def q_fill_columns(spark, sf_dir):
    fx, keys = Fixtures(spark, sf_dir), ["table_name", "column_name"]
    sugg = explode_replies(fx.fx_ai_columns)
    # The join deals the replies out as the columns are: in tasks of bounded size.
    return fill_from(fx.fx_columns.repartition(fx.parts("lineitem"), *keys), sugg, keys, ["description", "business_name"]) \
        .select("table_name", "column_name", "description", "business_name")


_FREQ_ALL = ", ".join(_q(x) for x in REFRESH_FREQUENCIES)
_FREQ_SET = ", ".join(_q(x) for x in REFRESH_FREQUENCIES if x)


def _pref(f: str) -> str:
    if f == "refresh_frequency":
        return (f"nullif(CASE WHEN p.{f} IN ({_FREQ_SET}) THEN p.{f} WHEN t.{f} IN ({_FREQ_ALL}) THEN t.{f} "
                f"ELSE '' END, '') AS {f}")
    return f"nullif(coalesce(nullif(p.{f}, ''), nullif(t.{f}, ''), ''), '') AS {f}"


@register("prefer_suggestions", with_fx(["fx_tables", "fx_ai_tables"], f"""
SELECT t.table_name, {', '.join(_pref(f) for f in TABLE_REPLY_FIELDS)}
FROM fx_tables t LEFT JOIN p ON t.table_name = p.table_name""", [("p", _PARSED)]))
def q_prefer_suggestions(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return prefer(fx.fx_tables, parse_replies(fx.fx_ai_tables), ["table_name"], TABLE_REPLY_FIELDS,
                  FREQUENCY_DOMAIN)
