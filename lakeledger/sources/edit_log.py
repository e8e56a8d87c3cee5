"""The edit queue as a log on shared storage (M5, M9).

Layout under the log's folder::

    part-*.parquet             appended edits; files are never changed
    _claims/<k>.json           ranges of sequence numbers: {first, next}
    _generations/<g>.json      what clearing left: {gone: [file...], rest: [folder...]}
    _rest/<id>/part-*.parquet  rows of cleared files that were not applied

**Appending** reserves a range of numbers by a claim that follows the last
one, so concurrent appenders never share a number.  **Reading** takes one
generation: the appended files that it doesn't list as gone, and its rest
folders.  **Clearing** after an apply makes the next generation: the files
that were read are gone, their rows that were not applied become a rest
folder.  Files that arrive between read and clear are in no list, so they stay
queued without any lock.  ``vacuum_queue`` removes gone files later.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.sources.commits import CommitLog, join, modified_ms, move_files, names, remove
from lakeledger.sources.schema import EDITS_SCHEMA


@dataclass(frozen=True)
class QueueRead:
    """What one read of the queue covered: a generation, its appended files and rest folders."""
    generation: int
    files: tuple[str, ...]
    rest: tuple[str, ...]


def _claims(spark: SparkSession, log_path: str) -> CommitLog:
    return CommitLog(spark, join(log_path, "_claims"))


def _generations(spark: SparkSession, log_path: str) -> CommitLog:
    return CommitLog(spark, join(log_path, "_generations"))


def _top(spark: SparkSession, log_path: str) -> int:
    """The number after the highest in the appended files (they may be older than the claims)."""
    try:
        top = spark.read.parquet(log_path).agg(F.max("seq")).first()[0]
    except AnalysisException as e:
        # An unreadable log is not an empty one; a folder with claims only is.
        if e.getCondition() == "PATH_NOT_FOUND" or e.getCondition() == "UNABLE_TO_INFER_SCHEMA" and not _files(spark, log_path):
            return 0
        raise
    return 0 if top is None else int(top) + 1


def reserve(spark: SparkSession, log_path: str, count: int, least: int = 0) -> int:
    """Reserve ``count`` neighbouring numbers from ``least`` on; the first of them.

    Each claim follows the one before it and can be made once, so two
    reservations never overlap, whoever makes them."""
    log = _claims(spark, log_path)
    while True:
        last, content = log.latest()
        first = max(least, content.get("next", 0))
        if log.append(last + 1, {"first": first, "next": first + count}):
            return first


def append_edits(log_path: str, edits: DataFrame, spark: SparkSession | None = None) -> int:
    """M5: append edits to the log at ``log_path``; the first sequence number used.

    ``edits`` needs keys, ``field``, ``value`` and ``edited_at``.  Rows are
    numbered from a range that no other append uses and that lies above every
    number in the log.  Edits that bring a ``seq`` keep it (unique numbers are
    then the caller's); later appends are numbered above.  The log gets whole
    files; an append that fails on its way may have left some of its own."""
    spark = spark or edits.sparkSession
    if "column_name" not in edits.columns:
        edits = edits.withColumn("column_name", F.lit(None).cast("string"))
    numbered = "seq" in edits.columns
    # Written once before the numbers are known: the source is not run twice, and retried tasks can't renumber rows.
    staged_at = join(log_path, "_staged", uuid.uuid4().hex)
    (edits.select("table_name", "column_name", "field", F.col("value").cast("string").alias("value"),
                  F.col("edited_at").cast("timestamp_ntz").alias("edited_at"),
                  (F.col("seq") if numbered else F.monotonically_increasing_id()).cast("long").alias("seq"))
     .write.parquet(staged_at))
    staged = spark.read.schema(EDITS_SCHEMA).parquet(staged_at)
    highest = staged.agg(F.max("seq")).first()[0]
    span = 0 if highest is None else int(highest) + 1
    top = _top(spark, log_path)
    if numbered:
        first = reserve(spark, log_path, 0, max(top, span))
    else:
        first = reserve(spark, log_path, span, top)
        staged = staged.withColumn("seq", F.col("seq") + F.lit(first))
    # Files are moved into the log: two jobs that write to one folder would clean up each other's temporary files.
    staged.write.parquet(staged_at + "-numbered")
    move_files(spark, staged_at + "-numbered", log_path)
    remove(spark, staged_at)
    remove(spark, staged_at + "-numbered")
    return first


def _files(spark: SparkSession, log_path: str) -> list[str]:
    return [n for n in names(spark, log_path) if not n.startswith(("_", "."))]


def queue_state(spark: SparkSession, log_path: str) -> QueueRead:
    """What the queue holds now."""
    number, content = _generations(spark, log_path).latest()
    gone = set(content.get("gone", []))
    return QueueRead(number, tuple(f for f in _files(spark, log_path) if f not in gone), tuple(content.get("rest", [])))


def read_queue(spark: SparkSession, log_path: str, at: QueueRead | None = None) -> DataFrame:
    """The queued edits of one state (default: now); later appends don't show in it."""
    at = at or queue_state(spark, log_path)
    paths = [join(log_path, f) for f in at.files] + [join(log_path, "_rest", r) for r in at.rest]
    return spark.read.schema(EDITS_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], EDITS_SCHEMA)


def consume_queue(spark: SparkSession, log_path: str, at: QueueRead, applied: DataFrame | None = None) -> QueueRead:
    """M9: clear what was applied; the queue's state after that.

    ``at`` is the state the apply read, ``applied`` the rows of it that were
    applied (default: all).  Rows are told apart by ``seq``.  Edits appended
    since the read stay.  When another clearing came first, only what it left
    of the files and folders in ``at`` is cleared."""
    log = _generations(spark, log_path)
    while True:
        number, content = log.latest()
        gone, rest = set(content.get("gone", [])), list(content.get("rest", []))
        # Rows another clearing moved to a rest folder of its own are looked for there.
        mine = QueueRead(number, tuple(f for f in at.files if f not in gone),
                         tuple(r for r in rest if r in at.rest or number != at.generation))
        left, folder = None, None
        if applied is not None and (mine.files or mine.rest):
            left = read_queue(spark, log_path, mine).join(applied.select("seq"), "seq", "left_anti").select(EDITS_SCHEMA.fieldNames())
        elif number != at.generation and mine.rest:
            read = read_queue(spark, log_path, at).select("seq")
            left = read_queue(spark, log_path, QueueRead(number, (), mine.rest)).join(read, "seq", "left_anti").select(EDITS_SCHEMA.fieldNames())
        if left is not None:
            folder = uuid.uuid4().hex
            left.write.parquet(join(log_path, "_rest", folder))
            if spark.read.schema(EDITS_SCHEMA).parquet(join(log_path, "_rest", folder)).isEmpty():
                remove(spark, join(log_path, "_rest", folder))
                folder = None
        here = set(_files(spark, log_path))
        after = {"gone": sorted((gone & here) | set(mine.files)), "rest": [r for r in rest if r not in mine.rest] + [folder] * (folder is not None)}
        if log.append(number + 1, after):
            return queue_state(spark, log_path)
        if folder is not None:
            remove(spark, join(log_path, "_rest", folder))


def vacuum_queue(spark: SparkSession, log_path: str, grace_hours: float = 24) -> int:
    """Remove files and rest folders that the current generation no longer reads; how many.

    Those changed in the last ``grace_hours`` stay for readers of an older generation."""
    _, content = _generations(spark, log_path).latest()
    old = [join(log_path, f) for f in content.get("gone", []) if f in set(_files(spark, log_path))]
    old += [join(log_path, "_rest", r) for r in names(spark, join(log_path, "_rest")) if r not in content.get("rest", [])]
    limit = time.time() * 1000 - grace_hours * 3_600_000
    old = [p for p in old if modified_ms(spark, p) <= limit]
    for p in old:
        remove(spark, p)
    return len(old)
