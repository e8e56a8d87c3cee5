"""Registered queries that write to a store or log and read back.

Each run uses a new folder below the session's shared checkpoint folder.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger import catalogue
from lakeledger.operators.edits import apply_edits, collapse_edits
from lakeledger.operators.profile import profile_all
from lakeledger.operators.reconcile import preserve_columns, preserve_tables, update_fields, upsert, upsert_fitted
from lakeledger.operators.report import export_nested, read_export, write_export
from lakeledger.operators.sketches import SKETCH_SCHEMA, relative_error, sketch_profile
from lakeledger.operators.suggest import PROMPT_COLUMN_LIMIT, TABLE_PROMPT_TAIL, table_prompts
from lakeledger.plans.driver_schema import DRIVER_COLUMNS
from lakeledger.plans.fixtures import Fixtures
from lakeledger.plans.oracle import with_fx
from lakeledger.plans.q_edits import _CF, _TF, _apply_sql
from lakeledger.plans.q_reconcile import _PRESERVE_COLUMNS, _PRESERVE_TABLES, _upsert_sql
from lakeledger.plans.q_scan import _q, _sql_layer
from lakeledger.plans.q_suggest import _TABLE_LINE, _TABLE_MID, _prompt_sql
from lakeledger.plans.registry import NOW, register
from lakeledger.session import scratch_path
from lakeledger.sources import edit_log, store
from lakeledger.sources.scan import live_tables, scan, scan_tables
from lakeledger.sources.schema import COLUMN_KEYS, COLUMNS_SCHEMA, TABLE_KEYS, TABLES_SCHEMA, fit
from lakeledger.sources.tables import CATALOGUE_NAMES, catalog_sources, catalog_tables, driver_sources, read_table, table_path

_T = TABLES_SCHEMA.fieldNames()
_C = COLUMNS_SCHEMA.fieldNames()
# ---- fixed values ----------------------------------------------------------
# Edits saved until here are applied and cleared; those saved after FIRST_PART
# are appended while the apply is at work.
CLEARED_TO = "2024-01-10T00:00:00"
FIRST_PART = "2024-01-20T00:00:00"
# ---------------------------------------------------------------------------


def _new(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# -- commit_catalogue: two writers from one base --------------------------------
# One merges a fresh scan, the other applies the queued edits; both have read
# the same state.  Whichever commits second is computed again, so the result
# is the scan merged first and the edits on top of it: fields of the two don't
# overlap but for the stamp, which the apply sets and the scan keeps.
_TABLES_AFTER = _apply_sql("up_t", "fx_edits", TABLE_KEYS, _TF, _T, "falsy")
_COLUMNS_AFTER = _apply_sql("up_c", "fx_column_edits", COLUMN_KEYS, _CF, _C, "null")
_COMMITTED = f"""
SELECT 'table' AS kind, table_name, CAST(NULL AS VARCHAR) AS column_name, layer AS type, row_count AS n, description, updated_at, scanned_at
FROM ({_TABLES_AFTER})
UNION ALL
SELECT 'column', table_name, column_name, data_type, CAST(ordinal_position AS BIGINT), description, updated_at, scanned_at
FROM ({_COLUMNS_AFTER})"""


@register("commit_catalogue", with_fx(
    ["fx_tables", "fx_columns", "fx_scan_tables", "fx_scan_columns", "fx_edits", "fx_column_edits"], _COMMITTED,
    [("pt", _PRESERVE_TABLES), ("pc", _PRESERVE_COLUMNS),
     ("up_t", _upsert_sql("fx_tables", "pt", TABLE_KEYS, _T)), ("up_c", _upsert_sql("fx_columns", "pc", COLUMN_KEYS, _C))]))
def q_commit_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx, root = Fixtures(spark, sf_dir), _new(spark, "commit-catalogue")
    store.transact(spark, root, lambda read: {store.TABLES: fx.fx_tables, store.COLUMNS: fx.fx_columns})

    def merge_scan(read):
        t, c = read(store.TABLES, TABLES_SCHEMA), read(store.COLUMNS, COLUMNS_SCHEMA)
        return {store.TABLES: upsert(t, preserve_tables(fx.fx_scan_tables, t), TABLE_KEYS),
                store.COLUMNS: upsert(c, preserve_columns(fx.fx_scan_columns, c), COLUMN_KEYS)}

    def apply_queue(read):
        t, c = read(store.TABLES, TABLES_SCHEMA), read(store.COLUMNS, COLUMNS_SCHEMA)
        if not overtaken:  # the scan commits after this one has read
            overtaken.append(store.transact(spark, root, merge_scan))
        return {store.TABLES: apply_edits(t, fx.fx_edits, TABLE_KEYS, NOW, drop="falsy"),
                store.COLUMNS: apply_edits(c, fx.fx_column_edits, COLUMN_KEYS, NOW, drop="null")}

    overtaken: list = []
    at = store.transact(spark, root, apply_queue)
    tables = store.read(spark, at, store.TABLES, TABLES_SCHEMA).select(
        F.lit("table").alias("kind"), "table_name", F.lit(None).cast("string").alias("column_name"), F.col("layer").alias("type"),
        F.col("row_count").alias("n"), "description", "updated_at", "scanned_at")
    columns = store.read(spark, at, store.COLUMNS, COLUMNS_SCHEMA).select(
        F.lit("column").alias("kind"), "table_name", "column_name", F.col("data_type").alias("type"),
        F.col("ordinal_position").cast("long").alias("n"), "description", "updated_at", "scanned_at")
    return tables.unionByName(columns)


# -- load_tables, load_columns: from a partitioned snapshot ---------------------
@register("load_tables", with_fx(["fx_tables"], f"SELECT {', '.join(_T)} FROM fx_tables WHERE layer IN ('gld', 'slv')"))
def q_load_tables(spark, sf_dir):
    root = _new(spark, "load-tables")
    store.save_tables(Fixtures(spark, sf_dir).fx_tables, root)
    return store.load_tables(spark, root, ["gld", "slv"])


@register("load_columns", with_fx(["fx_columns"], f"SELECT {', '.join(_C)} FROM fx_columns"))
def q_load_columns(spark, sf_dir):
    root = _new(spark, "load-columns")
    store.save_columns(Fixtures(spark, sf_dir).fx_columns, root)
    return store.load_columns(spark, root)


# -- append_edits: concurrent appenders -----------------------------------------
@register("append_edits", with_fx(["fx_edits"], """
SELECT table_name, field, value, edited_at, true AS own_seq, true AS ordered FROM fx_edits"""))
def q_append_edits(spark, sf_dir):
    """All edits, appended by four writers at a time; whether each has a number of its own, above those of its writer's earlier batch."""
    edits, log, errors = Fixtures(spark, sf_dir).fx_edits.drop("seq"), _new(spark, "append-edits"), []

    def writer(i: int) -> None:
        try:
            mine = edits.filter(F.pmod(F.hash("table_name"), F.lit(4)) == i)
            for batch in (F.col("edited_at") <= F.lit(FIRST_PART).cast("timestamp_ntz"), F.col("edited_at") > F.lit(FIRST_PART).cast("timestamp_ntz")):
                edit_log.append_edits(log, mine.filter(batch))
        except Exception as e:  # noqa: BLE001 - raised below
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    if errors:
        raise errors[0]
    queue = edit_log.read_queue(spark, log).withColumn("late", F.col("edited_at") > F.lit(FIRST_PART).cast("timestamp_ntz"))
    uses = queue.groupBy("seq").agg(F.count("*").alias("uses"))
    first = queue.groupBy("table_name").agg(F.max(F.when(~F.col("late"), F.col("seq"))).alias("before"))
    return queue.join(uses, "seq").join(first, "table_name").select(
        "table_name", "field", "value", "edited_at", (F.col("uses") == 1).alias("own_seq"),
        F.coalesce(~F.col("late") | (F.col("seq") > F.col("before")), F.lit(True)).alias("ordered"))


# -- consume_queue: an append between read and clear ------------------------------
@register("consume_queue", with_fx(["fx_edits"], f"""
SELECT table_name, field, value, edited_at FROM fx_edits WHERE edited_at > TIMESTAMP '{CLEARED_TO.replace("T", " ")}'"""))
def q_consume_queue(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    root, log = _new(spark, "consume-queue"), _new(spark, "consume-queue-log")
    store.save_tables(fx.fx_tables, root)
    edits, part = fx.fx_edits.drop("seq"), F.lit(FIRST_PART).cast("timestamp_ntz")
    edit_log.append_edits(log, edits.filter(F.col("edited_at") <= part))
    applied = catalogue.apply_queued(spark, root, log, NOW, up_to=CLEARED_TO)
    edit_log.append_edits(log, edits.filter(F.col("edited_at") > part))
    catalogue.consume_queue(spark, log, applied)
    return edit_log.read_queue(spark, log).select("table_name", "field", "value", "edited_at")


# -- scan_isolated: readable and broken sources -----------------------------------
_BROKEN_TABLES = ["orders", "events", "pages"]
_SCAN_ISOLATED = " UNION ALL ".join(
    [f"SELECT {_q(CATALOGUE_NAMES[t])} AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST({len(c)} AS INTEGER) AS column_count, "
     f"CAST(NULL AS VARCHAR) AS error_class FROM {t}" for t, c in DRIVER_COLUMNS.items()]
    + [f"SELECT 'brz_broken_{t}', NULL, NULL, 'USER_RAISED_EXCEPTION' FROM (SELECT count(*) AS n FROM {t}) WHERE n > 0" for t in _BROKEN_TABLES]
    + ["SELECT 'brz_missing', NULL, NULL, 'PATH_NOT_FOUND'"])


@register("scan_isolated", _SCAN_ISOLATED)
def q_scan_isolated(spark, sf_dir):
    """Row counts of the sources that can be read, and the failure of those that can't (while counting, or when opened)."""
    sources = dict(driver_sources(spark, sf_dir))
    for t in _BROKEN_TABLES:
        sources[f"brz_broken_{t}"] = read_table(spark, sf_dir, t).filter(F.raise_error(F.lit("this source is broken")).cast("boolean"))
    sources["brz_missing"] = lambda: spark.read.parquet(table_path(sf_dir, "no_such_table"))
    res = scan(spark, sources, NOW)
    return res.tables.select("table_name", "row_count", "column_count", F.lit(None).cast("string").alias("error_class")).unionByName(
        res.errors.select("table_name", F.lit(None).cast("long").alias("row_count"), F.lit(None).cast("int").alias("column_count"), "error_class"))


# -- sketch_distinct: estimates from stored, merged sketches ------------------------
def _sketch_sql() -> str:
    parts = []
    for t in ("lineitem", "orders"):
        for i, (c, _) in enumerate(DRIVER_COLUMNS[t], start=1):
            parts.append(f"SELECT {_q(CATALOGUE_NAMES[t])} AS table_name, {_q(c)} AS column_name, CAST(count(*) AS BIGINT) AS row_count, "
                         f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS exact_count, true AS within FROM {t}")
    return " UNION ALL ".join(parts)


@register("sketch_distinct", _sketch_sql())
def q_sketch_distinct(spark, sf_dir):
    """Per column: exact counts, and whether the estimate is within three standard errors of the exact distinct count.

    Sketches are stored in three refreshes: the first parts of both tables,
    the others, and one part again, which must not count twice."""
    li, orders, root = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"), _new(spark, "sketches")
    li_name, o_name = CATALOGUE_NAMES["lineitem"], CATALOGUE_NAMES["orders"]
    parts = {li_name: F.col("l_returnflag"), o_name: F.col("o_orderstatus")}
    early = {li_name: li.filter("l_returnflag = 'N'"), o_name: orders.filter("o_orderstatus = 'F'")}
    late = {li_name: li.filter("l_returnflag <> 'N'"), o_name: orders.filter("o_orderstatus <> 'F'")}
    for sources in (early, late, {li_name: early[li_name]}):
        catalogue.refresh_sketches(spark, sources, root, parts)
    stored = store.load(spark, root, store.SKETCHES, SKETCH_SCHEMA)
    got = sketch_profile(stored).select("table_name", "column_name", "row_count", "null_count", F.col("distinct_count").alias("estimate"))
    exact = profile_all(spark, {li_name: li, o_name: orders}).select("table_name", "column_name", F.col("distinct_count").alias("exact_count"))
    bound = F.col("exact_count") * (3 * relative_error())
    return got.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "row_count", "null_count", "exact_count",
        (F.abs(F.col("estimate") - F.col("exact_count")) <= bound).alias("within"))


# -- fit_rejects, upsert_fitted: sources that don't fit the target ------------------
_UNFIT = """
SELECT n.table_name AS TABLE_NAME,
       CASE o_orderkey % 9 WHEN 0 THEN 'brz' WHEN 1 THEN 'slv' WHEN 2 THEN 'gld' WHEN 3 THEN 'ref'
         WHEN 4 THEN 'dq' WHEN 5 THEN 'utl' WHEN 6 THEN 'dd' ELSE 'other' END AS Layer,
       CASE o_orderkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS Row_Count,
       CASE WHEN o_orderkey % 15 = 0 THEN '99999999999' ELSE '12' END AS column_count,
       'new' AS Scanned_At, o_orderstatus AS junk
FROM orders JOIN fx_names n ON n.k = o_orderkey"""
_FITS = "(Row_Count IS NULL OR TRY_CAST(Row_Count AS BIGINT) IS NOT NULL) AND TRY_CAST(column_count AS INTEGER) IS NOT NULL"
_FITTED = f"""
SELECT TABLE_NAME AS table_name, Layer AS layer, TRY_CAST(Row_Count AS BIGINT) AS row_count, TRY_CAST(column_count AS INTEGER) AS column_count,
       {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in _T[4:9])}, Scanned_At AS scanned_at,
       CAST(NULL AS VARCHAR) AS updated_at, CAST(NULL AS VARCHAR) AS updated_by
FROM unfit WHERE {_FITS}"""


def _unfit(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    rows = (F.when(k % 10 == 0, F.lit("n/a")).when(k % 10 == 1, F.lit("")).when(k % 10 == 2, F.lit(None).cast("string"))
            .otherwise(F.col("o_custkey").cast("string")))
    fx = Fixtures(spark, sf_dir)
    return read_table(spark, sf_dir, "orders").select(
        fx._name(k).alias("TABLE_NAME"), fx._layer_of(k).alias("Layer"), rows.alias("Row_Count"),
        F.when(k % 15 == 0, F.lit("99999999999")).otherwise(F.lit("12")).alias("column_count"),
        F.lit("new").alias("Scanned_At"), F.col("o_orderstatus").alias("junk"))


@register("fit_rejects", with_fx(["fx_names"], f"""
SELECT table_name, row_count, column_count, description, NULL AS field, NULL AS value, NULL AS target_type FROM ({_FITTED})
UNION ALL SELECT TABLE_NAME, NULL, NULL, NULL, 'row_count', Row_Count, 'bigint' FROM unfit WHERE Row_Count IS NOT NULL AND TRY_CAST(Row_Count AS BIGINT) IS NULL
UNION ALL SELECT TABLE_NAME, NULL, NULL, NULL, 'column_count', column_count, 'int' FROM unfit WHERE TRY_CAST(column_count AS INTEGER) IS NULL""",
                                 [("unfit", _UNFIT)]))
def q_fit_rejects(spark, sf_dir):
    fitted, rejects = fit(_unfit(spark, sf_dir), TABLES_SCHEMA, TABLE_KEYS)
    return fitted.select("table_name", "row_count", "column_count", "description").unionByName(rejects, allowMissingColumns=True)


@register("upsert_fitted", with_fx(["fx_tables", "fx_names"], _upsert_sql("fx_tables", "src", TABLE_KEYS, _T),
                                   [("unfit", _UNFIT), ("src", _FITTED)]))
def q_upsert_fitted(spark, sf_dir):
    return upsert_fitted(Fixtures(spark, sf_dir).fx_tables, _unfit(spark, sf_dir), TABLE_KEYS)[0]


# -- update_column_fields (M4): the last description saved per column ----------------
@register("update_column_fields", with_fx(["fx_columns", "fx_column_edits"], f"""
SELECT {', '.join(f"CASE WHEN e.table_name IS NOT NULL THEN e.description ELSE t.description END AS description" if c == "description"
                  else f"CASE WHEN e.table_name IS NOT NULL THEN '{NOW}' ELSE t.updated_at END AS updated_at" if c == "updated_at"
                  else f"t.{c}" for c in _C)}
FROM fx_columns t LEFT JOIN ed e ON t.table_name = e.table_name AND t.column_name = e.column_name""", [("ed", """
SELECT table_name, column_name, arg_max_null(value, (edited_at, seq)) AS description
FROM fx_column_edits WHERE field = 'description' GROUP BY table_name, column_name""")]))
def q_update_column_fields(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    last = collapse_edits(fx.fx_column_edits.filter(F.col("field") == "description"), COLUMN_KEYS, drop="none")
    return update_fields(fx.fx_columns, last.select(*COLUMN_KEYS, F.col("value").alias("description")), COLUMN_KEYS, NOW)


# -- table_prompts_wide (W1): tables of more columns than a prompt lists --------------
_WIDE_COLUMNS = """
SELECT concat('brz_t', CAST(o_orderkey % 20 AS VARCHAR)) AS table_name, concat('c', CAST(o_orderkey AS VARCHAR)) AS column_name,
       o_orderstatus AS data_type, CAST(o_orderkey // 20 AS INTEGER) AS ordinal_position, o_orderpriority AS sample_values
FROM orders"""
_WIDE_TABLES = "SELECT DISTINCT table_name, 'brz' AS layer FROM wide"


@register("table_prompts_wide", with_fx(
    [], re.sub(r"\bfx_tables\b", "wide_tables", _prompt_sql(_TABLE_LINE, _TABLE_MID, TABLE_PROMPT_TAIL, PROMPT_COLUMN_LIMIT)).replace(
        "fx_columns_profiled", "wide"), [("wide", _WIDE_COLUMNS), ("wide_tables", _WIDE_TABLES)]))
def q_table_prompts_wide(spark, sf_dir):
    k = F.col("o_orderkey")
    wide = read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("brz_t"), (k % 20).cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column_name"),
        F.col("o_orderstatus").alias("data_type"), F.floor(k / 20).cast("int").alias("ordinal_position"),
        F.col("o_orderpriority").alias("sample_values"))
    return table_prompts(wide.select("table_name", F.lit("brz").alias("layer")).distinct(), wide)


# -- export_round_trip (S12): nested documents written and read back ----------------
@register("export_round_trip", with_fx(["fx_tables", "fx_columns"], """
SELECT t.table_name, t.layer, t.row_count, t.column_count, t.description, t.refresh_frequency, t.tags, t.updated_at,
       c.column_name, c.ordinal_position, c.is_primary_key, c.description AS column_description, c.business_name,
       CAST(row_number() OVER (PARTITION BY t.table_name ORDER BY c.ordinal_position, c.column_name) AS INTEGER) AS place
FROM fx_tables t LEFT JOIN fx_columns c ON t.table_name = c.table_name"""))
def q_export_round_trip(spark, sf_dir):
    """Every column row in its place inside its table's document; a table without columns has one row."""
    fx, path = Fixtures(spark, sf_dir), _new(spark, "export")
    write_export(export_nested(fx.fx_tables, fx.fx_columns), path, compression="gzip")
    docs = read_export(spark, path, TABLES_SCHEMA, COLUMNS_SCHEMA)
    rows = docs.select("*", F.posexplode_outer("columns").alias("pos", "c"))
    return rows.select("table_name", "layer", "row_count", "column_count", "description", "refresh_frequency", "tags", "updated_at",
                       "c.column_name", "c.ordinal_position", "c.is_primary_key", F.col("c.description").alias("column_description"),
                       "c.business_name", (F.coalesce("pos", F.lit(0)) + 1).cast("int").alias("place"))


# -- catalog_tables (S1): base tables of the session catalog --------------------------
_IN_CATALOG = ["region", "nation", "customer", "orders", "documents"]


@register("catalog_tables", " UNION ALL ".join(
    f"SELECT '{CATALOGUE_NAMES[t]}' AS table_name, {_sql_layer(_q(CATALOGUE_NAMES[t]))} AS layer, CAST(count(*) AS BIGINT) AS row_count, "
    f"CAST({len(DRIVER_COLUMNS[t])} AS INTEGER) AS column_count, {_q(NOW)} AS scanned_at FROM {t}" for t in _IN_CATALOG))
def q_catalog_tables(spark, sf_dir):
    """The scan of a catalog's database: external tables in it, a view and an internal table left out."""
    db = f"lakeledger_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db}")
    try:
        for name, t in [(CATALOGUE_NAMES[t], t) for t in _IN_CATALOG] + [("dd_internal", "region")]:
            spark.sql(f"CREATE TABLE {db}.{name} USING parquet OPTIONS (path '{table_path(sf_dir, t)}')")
        spark.sql(f"CREATE VIEW {db}.slv_view AS SELECT * FROM {db}.ref_region")
        live = {r.table_name for r in live_tables(catalog_tables(spark, db)).collect()}
        # One row per table, counted while the database is there.
        out = _new(spark, "catalog-tables")
        scan_tables(spark, {n: df for n, df in catalog_sources(spark, db).items() if n in live}, NOW).write.parquet(out)
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.read.parquet(out)
