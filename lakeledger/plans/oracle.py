"""The fixture derivations as SQL, for the DuckDB oracle.

Written so the same text runs on DuckDB (and Spark SQL); ``with_fx`` puts the
needed blocks in front of a query as CTEs, in dependency order.
"""

from __future__ import annotations

FX_SQL: dict[str, str] = {
    "fx_names": """
SELECT o_orderkey AS k,
       concat(CASE o_orderkey % 9 WHEN 0 THEN 'brz_' WHEN 1 THEN 'slv_' WHEN 2 THEN 'gld_'
                WHEN 3 THEN 'ref_' WHEN 4 THEN 'dq_' WHEN 5 THEN 'utl_' WHEN 6 THEN 'dd_'
                WHEN 7 THEN 'brz2_' ELSE 'tmp_' END,
              't', CAST(o_orderkey AS VARCHAR)) AS table_name
FROM orders""",
    "fx_live_tables": """
SELECT table_name FROM fx_names WHERE k % 11 <> 0""",
    "fx_tables": """
SELECT n.table_name,
       CASE o_orderkey % 9 WHEN 0 THEN 'brz' WHEN 1 THEN 'slv' WHEN 2 THEN 'gld' WHEN 3 THEN 'ref'
         WHEN 4 THEN 'dq' WHEN 5 THEN 'utl' WHEN 6 THEN 'dd' ELSE 'other' END AS layer,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS row_count,
       CAST(o_custkey % 40 + 1 AS INT) AS column_count,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS description,
       CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderstatus END AS business_owner,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'erp' END AS source_system,
       CASE o_orderkey % 6 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'real-time' ELSE NULL END AS refresh_frequency,
       CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'a,b' END AS tags,
       '2024-01-01T00:00:00' AS scanned_at,
       CASE WHEN o_orderkey % 8 = 0 THEN '2024-01-15T00:00:00' ELSE NULL END AS updated_at,
       CAST(NULL AS VARCHAR) AS updated_by
FROM orders JOIN fx_names n ON n.k = o_orderkey
WHERE o_orderkey % 13 <> 0""",
    "fx_columns": """
SELECT n.table_name, concat('c', CAST(l_linenumber AS VARCHAR)) AS column_name,
       'double' AS data_type, l_linenumber AS ordinal_position,
       CASE WHEN l_linenumber = 1 THEN 'NO' ELSE 'YES' END AS is_nullable,
       l_linenumber = 1 AS is_primary_key,
       CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE max(l_returnflag) END AS description,
       CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN max(l_linestatus) ELSE NULL END AS business_name,
       CAST(NULL AS VARCHAR) AS sample_values, CAST(NULL AS DOUBLE) AS null_percentage,
       CAST(NULL AS BIGINT) AS distinct_count, '2024-01-01T00:00:00' AS scanned_at,
       CAST(NULL AS VARCHAR) AS updated_at, CAST(NULL AS VARCHAR) AS updated_by
FROM lineitem JOIN fx_names n ON n.k = l_orderkey
GROUP BY n.table_name, l_orderkey, l_linenumber""",
    "fx_scan_tables": """
SELECT n.table_name,
       CASE o_orderkey % 9 WHEN 0 THEN 'brz' WHEN 1 THEN 'slv' WHEN 2 THEN 'gld' WHEN 3 THEN 'ref'
         WHEN 4 THEN 'dq' WHEN 5 THEN 'utl' WHEN 6 THEN 'dd' ELSE 'other' END AS layer,
       CAST(floor(o_totalprice) AS BIGINT) + 1 AS row_count,
       CAST(o_custkey % 40 + 2 AS INT) AS column_count,
       '2024-02-01T00:00:00' AS scanned_at
FROM orders JOIN fx_names n ON n.k = o_orderkey
WHERE o_orderkey % 11 <> 0""",
    "fx_scan_columns": """
SELECT n.table_name, concat('c', CAST(l_linenumber AS VARCHAR)) AS column_name,
       'decimal' AS data_type, l_linenumber AS ordinal_position, 'YES' AS is_nullable,
       l_linenumber = 2 AS is_primary_key, '2024-02-01T00:00:00' AS scanned_at
FROM lineitem JOIN fx_names n ON n.k = l_orderkey
WHERE l_orderkey % 11 <> 0 AND l_linenumber < 7
GROUP BY n.table_name, l_orderkey, l_linenumber""",
    "fx_edits": """
SELECT n.table_name,
       CASE event_type WHEN 'click' THEN 'description' WHEN 'view' THEN 'business_owner'
         WHEN 'purchase' THEN 'source_system' WHEN 'signup' THEN 'refresh_frequency' ELSE 'tags' END AS field,
       CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('v', CAST(event_id AS VARCHAR)) END AS value,
       ts AS edited_at, event_id AS seq
FROM events JOIN fx_names n ON n.k = event_id % 500""",
    "fx_column_edits": """
SELECT n.table_name, concat('c', CAST(event_id % 7 + 1 AS VARCHAR)) AS column_name,
       CASE WHEN event_type IN ('click', 'view') THEN 'description' ELSE 'business_name' END AS field,
       CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('v', CAST(event_id AS VARCHAR)) END AS value,
       ts AS edited_at, event_id AS seq
FROM events JOIN fx_names n ON n.k = event_id % 500""",
    "fx_columns_edited": """
SELECT table_name, column_name,
       CASE WHEN ordinal_position = 3 THEN 'changed' WHEN description IS NULL THEN '' ELSE description END AS description,
       CASE WHEN ordinal_position = 4 THEN NULL ELSE business_name END AS business_name,
       CASE WHEN ordinal_position = 5 THEN true ELSE is_primary_key END AS is_primary_key
FROM fx_columns""",
    "fx_ai_tables": """
SELECT n.table_name,
       CASE o_orderkey % 5
         WHEN 0 THEN concat('```json', chr(10), '{"description": "d', CAST(o_orderkey AS VARCHAR), '", "refresh_frequency": "daily"}', chr(10), '```')
         WHEN 1 THEN concat('{"description": "d', CAST(o_orderkey AS VARCHAR), '", "business_owner": "Sales", "tags": "x, y"}')
         WHEN 2 THEN concat('Here: ```', '{"description": "", "refresh_frequency": "yearly"}', '``` done')
         WHEN 3 THEN '{"description": '
         ELSE '{"source_system": "crm"}' END AS response
FROM orders JOIN fx_names n ON n.k = o_orderkey""",
    "fx_ai_columns": """
SELECT a.table_name,
       CASE WHEN n.k % 5 = 3 THEN '[{"column_name": '
            ELSE concat('[', string_agg(a.obj, ', ' ORDER BY a.pos), ']') END AS response
FROM (
  SELECT table_name, ordinal_position * 2 AS pos,
         concat('{"column_name": "', column_name, '", "description": "sd_', column_name, '"',
                CASE WHEN ordinal_position = 6 THEN ''
                     ELSE concat(', "business_name": "B ', column_name, '"') END, '}') AS obj
  FROM fx_columns
  UNION ALL
  SELECT table_name, ordinal_position * 2 + 1 AS pos,
         concat('{"column_name": "', column_name, '", "description": "late_', column_name,
                '", "business_name": "late"}') AS obj
  FROM fx_columns WHERE ordinal_position = 2
) a JOIN fx_names n ON n.table_name = a.table_name
GROUP BY a.table_name, n.k""",
    "fx_columns_profiled": """
SELECT table_name, column_name, data_type, ordinal_position, description, business_name,
       CASE ordinal_position % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE concat('x', CAST(ordinal_position AS VARCHAR), ' | y') END AS sample_values,
       CASE WHEN ordinal_position = 7 THEN NULL ELSE round_even(ordinal_position * 12.5 / 3, 2) END AS null_percentage
FROM fx_columns""",
    "fx_lineitem_nulls": """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_partkey END AS l_partkey,
       nullif(l_returnflag, 'N') AS l_returnflag,
       CASE WHEN l_quantity > 25 THEN NULL ELSE l_shipdate END AS l_shipdate,
       CAST(NULL AS VARCHAR) AS all_null
FROM lineitem""",
    "fx_empty": """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 0""",
}

# Dependencies between the blocks (each needs the ones listed).
_DEPS = {
    "fx_live_tables": ["fx_names"], "fx_tables": ["fx_names"], "fx_columns": ["fx_names"],
    "fx_scan_tables": ["fx_names"], "fx_scan_columns": ["fx_names"], "fx_edits": ["fx_names"],
    "fx_column_edits": ["fx_names"], "fx_columns_edited": ["fx_columns"],
    "fx_ai_tables": ["fx_names"], "fx_columns_profiled": ["fx_columns"], "fx_ai_columns": ["fx_columns", "fx_names"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_fx(fx: list[str], body: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixture CTEs>, <extra CTEs> <body>``."""
    ctes = [f"{n} AS ({FX_SQL[n]}\n)" for n in _closure(fx)]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in (extra_ctes or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
