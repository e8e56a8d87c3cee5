"""The edit log: queue, collapse, overlay, apply, consume, diff
(J3, J4, J11, P7, W3, U4, M5-M9, A10, R6).

Edits are rows of a long, append-only log
``(keys..., field, value, edited_at, seq)``; ``column_name`` is NULL for
table-level edits.  The last write of a field wins, ordered by
``(edited_at, seq)``, so ties are always broken.

Everything that reads the log groups by the row key once: one aggregation
with a conditional ``max_by`` per field gives the wide "latest edits" row of
each key.  Partial aggregation runs before the shuffle, so a key that holds a
third of all edits still moves one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.functions.empties import differs_flag, differs_text
from lakeledger.functions.layers import detect_layer
from lakeledger.functions.text import iso_text
from lakeledger.sources.edit_log import append_edits  # noqa: F401 - M5, the queue itself lives with the sources

ORDER = ["edited_at", "seq"]


def keep_rule(value: Column, drop: str) -> Column:
    """Which edits count.  ``falsy``: drop NULL and '' (table edits);
    ``null``: drop NULL only (column edits); ``none``: keep all."""
    if drop == "falsy":
        return value.isNotNull() & (value != F.lit(""))
    if drop == "null":
        return value.isNotNull()
    if drop == "none":
        return F.lit(True)
    raise ValueError(f"unknown drop rule {drop!r}")


def collapse_edits(log: DataFrame, keys: list[str], drop: str = "falsy",
                   order: list[str] = ORDER) -> DataFrame:
    """One row per (keys, field): the last kept edit.

    Output ``keys..., field, value, edited_at, seq`` (the winner's)."""
    o = F.struct(*order)
    win = F.max_by(F.struct(F.col("value"), *[F.col(c) for c in order]), o)
    return (log.filter(keep_rule(F.col("value"), drop))
            .groupBy(*keys, "field").agg(win.alias("_w"))
            .select(*keys, "field", "_w.value", *[f"_w.{c}" for c in order]))


def pivot_edits(log: DataFrame, keys: list[str], fields: list[str], drop: str = "falsy",
                order: list[str] = ORDER) -> DataFrame:
    """U4/M6: one wide row per key that has any edit: each of ``fields`` is
    its last kept value (NULL if none), ``_last_edit`` is the time of the
    key's last save of any kind (it stamps ``updated_at`` on overlay), and
    ``_has_kept`` tells whether any field survived the drop rule."""
    keep = keep_rule(F.col("value"), drop)
    o = F.struct(*order)
    aggs = [F.max("edited_at").alias("_last_edit"),
            F.max(keep.cast("int")).cast("boolean").alias("_has_kept")]
    for f in fields:
        aggs.append(F.max_by(F.col("value"), F.when(keep & (F.col("field") == f), o)).alias(f))
    return log.groupBy(*keys).agg(*aggs)


def edited_fields(log: DataFrame) -> DataFrame:
    """U4: the distinct field names in the log."""
    return log.select("field").distinct()


def _editable(df: DataFrame, keys: list[str], stamp: str) -> list[str]:
    return [c for c in df.columns if c not in keys and c != stamp]


def overlay(df: DataFrame, log: DataFrame, keys: list[str], drop: str = "falsy",
            stamp: str = "updated_at") -> DataFrame:
    """Show queued edits on a read.  Only rows that exist change, only
    columns ``df`` has; key columns are never overwritten.  An edited row's
    ``stamp`` becomes the time of its last save (ISO text)."""
    fields = _editable(df, keys, stamp)
    wide = pivot_edits(log, keys, fields, drop)
    w = wide.select(*keys, F.lit(True).alias("_hit"), F.col("_last_edit"),
                    *[F.col(f).alias(f"_e_{f}") for f in fields])
    j = df.join(w, keys, "left")
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in fields:
            out.append(F.coalesce(F.col(f"_e_{c}").try_cast(types[c]), F.col(c)).alias(c))
        elif c == stamp:
            out.append(F.when(F.col("_hit"), iso_text("_last_edit")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)


def apply_edits(target: DataFrame, log: DataFrame, keys: list[str], now: str,
                drop: str = "falsy", insert: bool = False, stamp: str = "updated_at",
                fields: list[str] | None = None) -> DataFrame:
    """M7/M8: apply all queued edits as one upsert stamped with ``now``.

    A field only changes where an edit set it; other fields keep the stored
    value (Q1 fix: the batch never wipes unedited fields).  Keys whose edits
    were all dropped are skipped.  With ``insert`` edits for unknown keys
    become new rows (``layer`` from the name, ``scanned_at`` = ``now``);
    by default they are ignored, as an overlay would (Q3)."""
    fields = fields if fields is not None else _editable(target, keys, stamp)
    wide = pivot_edits(log, keys, fields, drop).filter(F.col("_has_kept"))
    w = wide.select(*keys, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_e_{f}") for f in fields])
    types = {f.name: f.dataType for f in target.schema.fields}
    if not insert:
        j = target.join(w, keys, "left")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
    else:
        t = target.withColumn("_in_target", F.lit(True))
        j = t.join(w, keys, "full")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for c in target.columns:
        if c in fields:
            e = F.coalesce(F.col(f"_e_{c}").try_cast(types[c]), F.col(c))
        elif c == stamp:
            e = F.when(hit, F.lit(now)).otherwise(F.col(c))
        else:
            e = F.col(c)
        if insert and c == "layer" and "table_name" in keys:
            e = F.coalesce(e, detect_layer("table_name"))
        elif insert and c == "scanned_at":
            e = F.coalesce(e, F.lit(now))
        out.append(e.cast(types[c]).alias(c))
    return j.select(out)


def bad_edits(log: DataFrame, schema: T.StructType) -> DataFrame:
    """The edits whose value does not cast to the type of the field they set
    (``overlay`` and ``apply_edits`` keep the stored value for these)."""
    bad = F.lit(False)
    for f in schema.fields:
        bad = bad | ((F.col("field") == f.name) & F.col("value").try_cast(f.dataType).isNull())
    return log.filter(F.col("value").isNotNull() & bad)


def consume_edits(log: DataFrame, applied: DataFrame) -> DataFrame:
    """M9: the queue without exactly the ``applied`` edits (rows of the log as
    they were read for the apply).  All columns are compared, so this holds for
    any log frame, and an edit that arrived meanwhile stays, whatever its
    ``seq`` or time.  ``sources.edit_log.consume_queue`` does it on the stored queue."""
    gone = applied.select(*[F.col(c).alias(f"_a_{c}") for c in log.columns])
    return log.join(gone, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in log.columns], "left_anti")


def pending(table_log: DataFrame, column_log: DataFrame) -> DataFrame:
    """A10: number of tables and of columns with queued edits (one row,
    one job; the two logs are unioned, not joined)."""
    both = (table_log.select(F.lit("t").alias("_k"), "table_name", F.lit(None).cast("string").alias("column_name"))
            .unionByName(column_log.select(F.lit("c").alias("_k"), "table_name", "column_name")))
    return both.agg(
        F.count_distinct(F.when(F.col("_k") == "t", F.col("table_name"))).alias("pending_tables"),
        F.count_distinct(F.when(F.col("_k") == "c", F.struct("table_name", "column_name"))).alias("pending_columns"))


def diff_rows(before: DataFrame, after: DataFrame, keys: list[str], text_fields: list[str],
              flag_fields: list[str] = ()) -> DataFrame:
    """Changed fields between two versions of keyed rows, long form
    ``keys..., field, old_value, new_value``.  Rows pair by key (not by
    position).  Text compares with NULL = ''; flags with NULL = false, and a
    changed flag is written as '1' / '0'."""
    b = before.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in list(text_fields) + list(flag_fields)])
    a = after.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in list(text_fields) + list(flag_fields)])
    j = b.join(a, keys, "inner")

    def flag_text(c: Column) -> Column:
        return F.when(F.coalesce(c.cast("boolean"), F.lit(False)), F.lit("1")).otherwise(F.lit("0"))

    items = []
    for f in text_fields:
        items.append(F.struct(F.lit(f).alias("field"),
                              differs_text(F.col(f"_b_{f}"), F.col(f"_a_{f}")).alias("changed"),
                              F.col(f"_b_{f}").cast("string").alias("old_value"),
                              F.col(f"_a_{f}").cast("string").alias("new_value")))
    for f in flag_fields:
        items.append(F.struct(F.lit(f).alias("field"),
                              differs_flag(F.col(f"_b_{f}"), F.col(f"_a_{f}")).alias("changed"),
                              flag_text(F.col(f"_b_{f}")).alias("old_value"),
                              flag_text(F.col(f"_a_{f}")).alias("new_value")))
    return (j.select(*keys, F.inline(F.array(*items)))
            .filter(F.col("changed"))
            .select(*keys, "field", "old_value", "new_value"))


def diff_count(diff: DataFrame, keys: list[str]) -> DataFrame:
    """The number of changed rows."""
    return diff.select(*keys).distinct().agg(F.count(F.lit(1)).alias("changed_rows"))
