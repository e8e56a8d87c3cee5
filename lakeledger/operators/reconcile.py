"""Reconciling a fresh scan with the stored catalogue (J2, J6-J8, U2, M1-M4,
M10, M11, A13).

All of these are keyed joins.  Catalogue keys are unique on both sides, so
no key is hot; joins shuffle both sides on the key once (AQE turns a side
into a broadcast at run time when its measured size is under the threshold,
so nothing here broadcasts on a guess).  Upserts cannot rely on row-level
DML (built-in parquet tables have none), so an upsert is a full outer join
that takes the source side wherever the source has the key; the caller
writes the result as a new snapshot (``sources.store``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.functions.empties import has_text
from lakeledger.sources.schema import (
    COLUMN_KEYS, COLUMNS_SCHEMA, TABLE_KEYS, TABLES_SCHEMA, align_to, fit,
)

# ---- fixed values: what a re-scan keeps from the stored rows ---------------
TABLE_PRESERVED = ["description", "business_owner", "source_system",
                   "refresh_frequency", "tags", "updated_at", "updated_by"]
COLUMN_PRESERVED = ["description", "business_name", "updated_at", "updated_by"]
COLUMN_PRESERVED_FLAGS = ["is_primary_key"]
# ---------------------------------------------------------------------------


def _or_text(old: Column, new: Column) -> Column:
    """Python's ``old or new`` for text: old when non-empty, else new."""
    return F.when(has_text(old), old).otherwise(new)


def _or_flag(old: Column, new: Column) -> Column:
    """``old or new`` for a flag: true when old is true, else new (Q5)."""
    return F.when(F.coalesce(old.cast("boolean"), F.lit(False)), F.lit(True)).otherwise(new.cast("boolean"))


def preserve(scan: DataFrame, stored: DataFrame, keys: list[str], fields: list[str],
             flags: list[str] = (), schema=None) -> DataFrame:
    """Keep what people wrote across a re-scan.

    Every scanned row is kept; where ``stored`` has the key, each of
    ``fields`` becomes ``stored or scanned`` (non-empty stored text wins, so a
    stored '' turns into the scanned value, usually NULL: Q4) and each of
    ``flags`` becomes ``stored or scanned`` (a stored true is sticky: Q5).
    Output has the columns of ``schema`` (default: the scan's own plus the
    preserved ones).  A key that ``stored`` has twice fails the job."""
    cols = list(schema.fieldNames()) if schema is not None else \
        list(scan.columns) + [f for f in list(fields) + list(flags) if f not in scan.columns]
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    old = stored.select(*keys, *[F.col(f).alias(f"_old_{f}") for f in list(fields) + list(flags)
                                 if f in stored.columns])
    j = scan.join(guard_unique(old, keys, "stored rows")[0], keys, "left")

    def new(c: str) -> Column:
        if c in scan.columns:
            return F.col(c)
        return F.lit(None).cast(types[c]) if c in types else F.lit(None)

    out = []
    for c in cols:
        if c in fields and f"_old_{c}" in j.columns:
            e = _or_text(F.when(F.col("_present"), F.col(f"_old_{c}")), new(c))
        elif c in flags and f"_old_{c}" in j.columns:
            e = _or_flag(F.col(f"_old_{c}"), new(c))
        else:
            e = new(c)
        out.append(e.cast(types[c]).alias(c) if c in types else e.alias(c))
    return j.select(out)


def preserve_tables(scan: DataFrame, stored: DataFrame) -> DataFrame:
    return preserve(scan, stored, TABLE_KEYS, TABLE_PRESERVED, [], TABLES_SCHEMA)


def preserve_columns(scan: DataFrame, stored: DataFrame) -> DataFrame:
    return preserve(scan, stored, COLUMN_KEYS, COLUMN_PRESERVED, COLUMN_PRESERVED_FLAGS, COLUMNS_SCHEMA)


def guard_unique(df: DataFrame, keys: list[str], what: str = "source") -> tuple[DataFrame, Column]:
    """Mark ``df`` so that a key occurring twice fails the job (as SQL MERGE
    does) instead of multiplying rows in a join.

    Returns the frame with a ``_present`` column: always true, but computed
    through a per-key count, so it cannot be pruned away.  The count is a
    window partitioned by the keys: the join on the same keys that follows
    reuses that partitioning, so the check costs no extra shuffle."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    msg = F.concat(F.lit(f"duplicate key in {what}: "), F.to_json(F.struct(*keys)))
    present = F.when(n > 1, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_present", present), F.col("_present")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], check_unique: bool = True) -> DataFrame:
    """M1/M2: MERGE by ``keys``: matched rows take every non-key field from
    the source, unmatched source rows are inserted, target rows the source
    lacks stay as they are.  The result has the target's schema; the source
    is fitted to it first (case-insensitive names, missing fields NULL)."""
    src = align_to(source, target.schema)
    if check_unique:
        src, _ = guard_unique(src, keys)
    else:
        src = src.withColumn("_present", F.lit(True))
    s = src.select(*[F.col(c).alias(f"_s_{c}") for c in target.columns], F.col("_present").alias("_s_present"))
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in target.columns])
    cond = [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys]
    j = t.join(s, cond, "full")
    took = F.coalesce(F.col("_s_present"), F.lit(False))
    return j.select([F.when(took, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c)
                     for c in target.columns])


def upsert_fitted(target: DataFrame, source: DataFrame, keys: list[str], check_unique: bool = True) -> tuple[DataFrame, DataFrame]:
    """M1/M2 of a source that may not fit: ``(result, rejects)``.

    Rows that fit the target's types are merged; a row with a value that does
    not cast, or without a key, changes nothing and is listed (``schema.fit``)."""
    good, rejects = fit(source, target.schema, keys)
    return upsert(target, good, keys, check_unique), rejects


def update_fields(target: DataFrame, edits: DataFrame, keys: list[str], now: str | None,
                  stamp: str = "updated_at", check_unique: bool = True) -> DataFrame:
    """M3/M4: set the fields present in ``edits`` (NULL allowed: it clears)
    on the rows with matching keys and stamp ``stamp`` with ``now``; rows
    without a match are unchanged.  ``edits`` is keyed by ``keys``."""
    fields = [c for c in edits.columns if c not in keys]
    unknown = [f for f in fields if f not in target.columns]
    if unknown:
        raise ValueError(f"fields not in target: {unknown}")
    e = edits.select(*keys, *[F.col(f).alias(f"_e_{f}") for f in fields])
    if check_unique:
        e, _ = guard_unique(e, keys, "edits")
    else:
        e = e.withColumn("_present", F.lit(True))
    j = target.join(e, keys, "left")
    hit = F.coalesce(F.col("_present"), F.lit(False))
    types = {f.name: f.dataType for f in target.schema.fields}
    out = []
    for c in target.columns:
        if c in fields:
            out.append(F.when(hit, F.col(f"_e_{c}").cast(types[c])).otherwise(F.col(c)).alias(c))
        elif c == stamp and now is not None:
            out.append(F.when(hit, F.lit(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)


# -- stale records -------------------------------------------------------------
def stale_tables(stored: DataFrame, live: DataFrame, key: str = "table_name") -> DataFrame:
    """Stored table names that are not live."""
    return stored.select(key).join(live.select(key), key, "left_anti")


def stale_columns(stored_cols: DataFrame, live: DataFrame,
                  live_columns: DataFrame | None = None) -> DataFrame:
    """Stored columns whose table is not live (Q7: a column dropped from
    a living table is not found this way).  With ``live_columns`` also the
    (table, column) pairs of living tables that no longer exist."""
    cols = stored_cols.select("table_name", "column_name", "ordinal_position")
    gone_table = cols.join(live.select("table_name"), "table_name", "left_anti")
    if live_columns is None:
        return gone_table
    living = cols.join(live.select("table_name"), "table_name", "left_semi")
    gone_pair = living.join(live_columns.select("table_name", "column_name"),
                            ["table_name", "column_name"], "left_anti")
    return gone_table.unionByName(gone_pair)


def orphan_columns(stale_cols: DataFrame, stale_tabs: DataFrame) -> DataFrame:
    """Stale columns whose table is not itself a stale table row."""
    return stale_cols.join(stale_tabs.select("table_name"), "table_name", "left_anti")


def stale_report(orphans: DataFrame) -> DataFrame:
    """Orphan columns per table: count and names in ordinal order.
    The list per table is bounded by that table's width."""
    g = orphans.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("_c"))
    return g.select("table_name", "n_columns",
                    F.array_join(F.col("_c.column_name"), ", ").alias("column_list"))


def check_live(live: DataFrame, force: bool = False) -> None:
    """Q8 fix: an empty live list would make every record stale; refuse
    unless forced.  (One ``limit 1`` probe.)"""
    if not force and live.isEmpty():
        raise ValueError("live table list is empty: refusing to treat every record as stale")


def delete_stale(tables: DataFrame, columns: DataFrame, live: DataFrame,
                 live_columns: DataFrame | None = None, force: bool = False,
                 check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Drop stale tables with all their columns (cascade) and orphan
    columns.  Together that removes every column whose table is not live;
    with ``live_columns`` also vanished columns of living tables."""
    if check:
        check_live(live, force)
    live_names = live.select("table_name")
    kept_tables = tables.join(live_names, "table_name", "left_semi")
    kept_cols = columns.join(live_names, "table_name", "left_semi")
    if live_columns is not None:
        kept_cols = kept_cols.join(live_columns.select("table_name", "column_name"),
                                   ["table_name", "column_name"], "left_semi")
    return kept_tables, kept_cols
