"""Applying the edit log incrementally with Structured Streaming (M5-M9).

The edit log is an append-only parquet folder (``operators.edits.append_edits``).
A streaming query over it hands each new batch of edits to ``foreachBatch``,
which applies them to the latest catalogue snapshot (``apply_edits``) and
commits a new snapshot.  The stream's checkpoint records which log files
were applied, which is exactly "consume the queue": applied edits are never
applied twice by offset, and edits that arrive while a batch runs are picked
up by the next one, never dropped.

Edits can arrive late: an edit saved earlier may land in a later batch.
To give the same field values as applying the whole log at once, the
applier keeps a small state table in the store, ``<level>_edit_state``:
for each (key, field) the ``(edited_at, seq)`` of the value it applied.  A
batch applies only winners newer than that.  Target and state are one commit,
so a replayed batch finds its edits applied, and another writer's commit in
between leads to the batch being applied on top of it.

``trigger(availableNow=True)`` makes it a catch-up job: apply everything
queued, then stop.  The checkpoint must live on shared storage; by default
it goes under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeledger.operators.edits import apply_edits, collapse_edits
from lakeledger.operators.reconcile import upsert
from lakeledger.session import scratch_path
from lakeledger.sources import store
from lakeledger.sources.schema import (
    COLUMN_KEYS, COLUMNS_SCHEMA, EDITS_SCHEMA, TABLE_KEYS, TABLES_SCHEMA,
)


def _now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat()


def edit_stream(spark: SparkSession, log_path: str) -> DataFrame:
    """The edit log as a stream (schema fixed, no inference)."""
    return spark.readStream.schema(EDITS_SCHEMA).parquet(log_path)


def apply_edit_stream(spark: SparkSession, log_path: str, root: str, level: str = "tables",
                      checkpoint: str | None = None, available_now: bool = True,
                      now_fn=_now) -> StreamingQuery:
    """Start a query that applies queued edits of one ``level``
    (``"tables"`` or ``"columns"``) to the catalogue under ``root``."""
    if level == "tables":
        keys, schema, name, drop = TABLE_KEYS, TABLES_SCHEMA, store.TABLES, "falsy"
        pick = F.col("column_name").isNull()
    elif level == "columns":
        keys, schema, name, drop = COLUMN_KEYS, COLUMNS_SCHEMA, store.COLUMNS, "null"
        pick = F.col("column_name").isNotNull()
    else:
        raise ValueError(level)
    ckpt = checkpoint or scratch_path(spark, f"edit-stream-{level}")

    state_name = f"{name}_edit_state"
    state_schema = f"{', '.join(k + ' string' for k in keys)}, field string, edited_at timestamp_ntz, seq long"

    def apply_batch(edits: DataFrame, epoch_id: int) -> None:
        batch = edits.filter(pick)
        if batch.isEmpty():
            return
        winners = collapse_edits(batch, keys, drop=drop)
        empty_state = spark.createDataFrame([], state_schema).schema

        def change(read):
            state = read(state_name, empty_state)
            seen = state.select(*keys, "field", F.struct("edited_at", "seq").alias("_applied"))
            newer = (winners.join(seen, [*keys, "field"], "left")
                     .filter(F.col("_applied").isNull() | (F.struct("edited_at", "seq") > F.col("_applied")))
                     .drop("_applied"))
            return {name: apply_edits(read(name, schema), newer, keys, now_fn(), drop=drop),
                    state_name: upsert(state, newer.select(*keys, "field", "edited_at", "seq"), [*keys, "field"])}

        store.transact(spark, root, change)

    writer = (edit_stream(spark, log_path).writeStream
              .foreachBatch(apply_batch)
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
