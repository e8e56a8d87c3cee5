"""End-to-end catalogue workflows over a snapshot store.

Each workflow reads one committed state, builds one lazy plan from the
operators and commits table rows and column rows together
(``sources.store.transact``): a workflow that another writer overtook is
computed again on the new state.  Nothing passes through the driver but
schemas, file names and version numbers.

- ``refresh``        scan sources -> preserve user fields -> upsert -> commit
- ``refresh_stats``  profile sources -> attach statistics to column rows -> commit
- ``refresh_sketches``  sum up new parts of tables -> merge with stored sketches -> commit with the estimates
- ``cleanup``        drop stale tables (with their columns) and orphan columns -> commit
- ``apply_queued``   apply the queued edits -> commit; returns what was applied
- ``consume_queue``  clear what was applied from the queue
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.functions.layers import EXCLUDE_PREFIXES
from lakeledger.operators.edits import apply_edits
from lakeledger.operators.profile import attach_stats, profile_all
from lakeledger.operators.reconcile import delete_stale, preserve_columns, preserve_tables, upsert
from lakeledger.operators.sketches import SKETCH_SCHEMA, replace_parts, sketch_all, sketch_profile
from lakeledger.session import scratch_path
from lakeledger.sources import edit_log, store
from lakeledger.sources.commits import remove
from lakeledger.sources.scan import scan
from lakeledger.sources.schema import COLUMN_KEYS, COLUMNS_SCHEMA, TABLE_KEYS, TABLES_SCHEMA


@dataclass
class RefreshResult:
    version: int
    tables_version: int
    columns_version: int
    errors: DataFrame


@dataclass(frozen=True)
class AppliedEdits:
    """What ``apply_queued`` did: the catalogue commit, the queue state it read and its time cut-off."""
    version: int
    queue: edit_log.QueueRead
    up_to: str | None = None


def _stored(read: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    return read(store.TABLES, TABLES_SCHEMA), read(store.COLUMNS, COLUMNS_SCHEMA)


def _frames(tables: DataFrame, columns: DataFrame) -> dict[str, DataFrame]:
    return {store.TABLES: tables.select(TABLES_SCHEMA.fieldNames()), store.COLUMNS: columns.select(COLUMNS_SCHEMA.fieldNames())}


def refresh(spark: SparkSession, sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
            root: str, now: str, keys: DataFrame | None = None,
            exclude=EXCLUDE_PREFIXES) -> RefreshResult:
    """Scan ``sources`` and merge the result into the catalogue at ``root``.

    User-written fields survive (``preserve``); statistics are reset to
    NULL by the scan (they are refreshed on request by ``refresh_stats``)."""
    res = scan(spark, sources, now, keys=keys, exclude=exclude)
    store.ensure_catalogue(spark, root)

    def change(read):
        stored_t, stored_c = _stored(read)
        return _frames(upsert(stored_t, preserve_tables(res.tables, stored_t), TABLE_KEYS),
                       upsert(stored_c, preserve_columns(res.columns, stored_c), COLUMN_KEYS))

    done = store.transact(spark, root, change)
    return RefreshResult(done.version, done.frames[store.TABLES].version, done.frames[store.COLUMNS].version, res.errors)


def refresh_stats(spark: SparkSession, sources: Mapping[str, DataFrame], root: str,
                  mode: str = "exact", rsd: float = 0.05, batch_tables: int | None = None) -> int:
    """Profile ``sources`` and store the statistics on the column rows;
    columns not profiled keep what they had.

    By default all sources are profiled in one job.  With ``batch_tables``
    they are profiled that many tables at a time and every batch is
    committed as its own snapshot: each job's shuffle stays bounded, and a
    failure late in a large refresh only repeats its own batch (the earlier
    ones are already written to the shared store).  Returns the last version
    of the column rows."""
    names = list(sources)
    size = batch_tables or max(1, len(names))
    version = -1
    for i in range(0, len(names), size):
        stats = profile_all(spark, {n: sources[n] for n in names[i:i + size]}, mode=mode, with_samples=True, rsd=rsd)
        # Stored first: a change that has to be computed again does not profile again.
        path = scratch_path(spark, f"stats-{uuid.uuid4().hex}")
        stats.write.parquet(path)
        found = spark.read.schema(stats.schema).parquet(path)
        done = store.transact(spark, root, lambda read: {store.COLUMNS: attach_stats(read(store.COLUMNS, COLUMNS_SCHEMA), found)})
        remove(spark, path)
        version = done.frames[store.COLUMNS].version
    return version


def refresh_sketches(spark: SparkSession, sources: Mapping[str, DataFrame], root: str,
                     parts: Mapping[str, Column | str] | None = None) -> int:
    """Sum up the given parts of tables, merge them with the stored sketches
    and put the estimates on the column rows; one commit of both.

    ``sources`` holds the new or changed parts of each table only, ``parts``
    its part column or the part's name (``operators.sketches``); parts that
    aren't given are not read.  Returns the commit."""
    store.ensure_catalogue(spark, root)
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    sketch_all(sources, parts).write.parquet(path)
    new = spark.read.schema(SKETCH_SCHEMA).parquet(path)

    def change(read):
        kept = replace_parts(read(store.SKETCHES, SKETCH_SCHEMA), new)
        return {store.SKETCHES: kept, store.COLUMNS: attach_stats(read(store.COLUMNS, COLUMNS_SCHEMA), sketch_profile(kept))}

    done = store.transact(spark, root, change)
    remove(spark, path)
    return done.version


def cleanup(spark: SparkSession, root: str, live: DataFrame, live_columns: DataFrame | None = None,
            force: bool = False) -> tuple[int, int]:
    """Remove stale tables with their columns, and orphan columns, as one commit."""
    done = store.transact(spark, root, lambda read: _frames(*delete_stale(*_stored(read), live, live_columns, force)))
    return done.frames[store.TABLES].version, done.frames[store.COLUMNS].version


def _until(log: DataFrame, up_to: str | None) -> DataFrame:
    return log if up_to is None else log.filter(F.col("edited_at") <= F.lit(up_to).cast("timestamp_ntz"))


def apply_queued(spark: SparkSession, root: str, log_path: str, now: str, up_to: str | None = None) -> AppliedEdits:
    """Apply the queued edits (of tables and columns) saved until ``up_to``
    (default: all) as one commit.

    Pass the result to ``consume_queue``; edits that arrive meanwhile are
    neither applied nor cleared.  A crash between the two is harmless: the
    same edits applied again set the same values.  The commit's notes name
    the queue's generation."""
    at = edit_log.queue_state(spark, log_path)
    batch = _until(edit_log.read_queue(spark, log_path, at), up_to)
    store.ensure_catalogue(spark, root)

    def change(read):
        stored_t, stored_c = _stored(read)
        return _frames(apply_edits(stored_t, batch.filter(F.col("column_name").isNull()), TABLE_KEYS, now, drop="falsy"),
                       apply_edits(stored_c, batch.filter(F.col("column_name").isNotNull()), COLUMN_KEYS, now, drop="null"))

    if not at.files and not at.rest:
        return AppliedEdits(store.state(spark, root).version, at, up_to)
    done = store.transact(spark, root, change, {"edit_log": log_path, "generation": at.generation})
    return AppliedEdits(done.version, at, up_to)


def consume_queue(spark: SparkSession, log_path: str, applied: AppliedEdits) -> edit_log.QueueRead:
    """Clear the edits that ``apply_queued`` applied; the queue's state after that."""
    rows = None if applied.up_to is None else _until(edit_log.read_queue(spark, log_path, applied.queue), applied.up_to)
    return edit_log.consume_queue(spark, log_path, applied.queue, rows)
