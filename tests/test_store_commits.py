"""Commits of the store and the edit queue: several writers, one state, nothing lost."""

import os
import shutil
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from lakeledger import catalogue
from lakeledger.operators.reconcile import upsert
from lakeledger.sources import edit_log, store
from lakeledger.sources.commits import CommitLog, put_if_absent
from tests.conftest import ROOT

EDIT = "table_name string, field string, value string, edited_at string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def at_once(*work):
    """Run the functions in threads; re-raise what one of them raised."""
    errors = []

    def run(f):
        try:
            f()
        except BaseException as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    [t.start() for t in threads]
    [t.join() for t in threads]
    if errors:
        raise errors[0]


def test_one_of_many_creates_a_commit(spark, tmp_path):
    made = []
    at_once(*[lambda i=i: made.append((put_if_absent(spark, f"{tmp_path}/x/a.json", str(i)), i)) for i in range(8)])
    won = [i for ok, i in made if ok]
    assert len(won) == 1 and (tmp_path / "x" / "a.json").read_text() == str(won[0])
    assert os.listdir(tmp_path / "x") == ["a.json"]
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.latest() == (-1, {}) and log.append(0, {"a": 1}) and not log.append(0, {"a": 2}) and log.append(1, {})
    assert log.latest() == (1, {}) and log.read(0) == {"a": 1}


def test_two_writers_from_one_base_lose_no_row(spark, tmp_path):
    root, together, reads = str(tmp_path), threading.Barrier(2), []
    store.write_snapshot(frame(spark, ("a", 1)), root, "f")

    def writer(row):
        def change(read):
            stored = read("f")
            reads.append(row)
            if reads.count(row) == 1:
                together.wait(60)  # both have read the same state
            return {"f": upsert(stored, frame(spark, row), ["k"])}
        return lambda: store.transact(spark, root, change)

    at_once(writer(("b", 2)), writer(("c", 3)))
    assert sorted(map(tuple, store.load(spark, root, "f").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert len(reads) == 3  # the one that came second computed its change again
    assert store.state(spark, root).frames["f"].version == 2


def test_changes_of_different_frames_are_not_computed_again(spark, tmp_path):
    root, calls = str(tmp_path), []
    store.write_snapshot(frame(spark, ("a", 1)), root, "f")

    def change(read):
        calls.append(1)
        store.write_snapshot(frame(spark, ("x", 9)), root, "g")  # another writer, another frame
        return {"f": read("f").withColumn("v", F.col("v") + 1)}
    done = store.transact(spark, root, change)
    assert len(calls) == 1 and done.version == 2
    assert [tuple(r) for r in store.load(spark, root, "f").collect()] == [("a", 2)]
    assert [tuple(r) for r in store.load(spark, root, "g").collect()] == [("x", 9)]


def test_a_frame_that_was_only_read_counts_too(spark, tmp_path):
    root, calls = str(tmp_path), []
    store.write_snapshot(frame(spark, ("a", 1)), root, "f")

    def change(read):
        rows = read("f")
        calls.append(1)
        if len(calls) == 1:
            store.write_snapshot(frame(spark, ("a", 5)), root, "f")
        return {"copy": rows}
    store.transact(spark, root, change)
    assert len(calls) == 2 and store.load(spark, root, "copy").first().v == 5


def test_a_stale_base_is_refused_and_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    store.write_snapshot(frame(spark, ("a", 1)), root, "f")
    base = store.state(spark, root)
    store.write_snapshot(frame(spark, ("a", 2)), root, "f", base=base)
    with pytest.raises(store.Conflict):
        store.write_snapshot(frame(spark, ("a", 3)), root, "f", base=base)
    with pytest.raises(store.Conflict):
        store.commit(spark, root, {"f": frame(spark, ("a", 4))}, base)
    assert store.load(spark, root, "f").first().v == 2
    assert len(os.listdir(tmp_path / "f")) == 2
    assert store.read(spark, base, "f").first().v == 1  # a reader keeps its state


def test_readers_see_both_frames_of_one_commit(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        store.transact(spark, root, lambda read: {"t": frame(spark, ("t", i)), "c": frame(spark, ("c", i))})
        at = store.state(spark, root)
        assert store.read(spark, at, "t").first().v == store.read(spark, at, "c").first().v == i
    assert store.read(spark, store.state(spark, root, 0), "c").first().v == 0
    log = store._read_log(spark, root, "c").collect()
    assert sorted(r.version for r in log) == [0, 1, 2]


def test_vacuum_keeps_what_commits_name(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        store.write_snapshot(frame(spark, ("a", i)), root, "f")
    (tmp_path / "f" / "v=00000009-crashed").mkdir()
    assert store.vacuum(spark, root, keep=2, grace_hours=24) == 0
    assert store.vacuum(spark, root, keep=2, grace_hours=0) == 3
    assert store.read(spark, store.state(spark, root, 2), "f").first().v == 2
    assert store.load(spark, root, "f").first().v == 3


def test_appenders_never_share_a_number(spark, tmp_path):
    log = str(tmp_path / "log")
    edits = [spark.createDataFrame([(f"t{i}_{j}", "tags", "x", "2024-01-01") for j in range(7)], EDIT).repartition(3) for i in range(5)]
    firsts = []
    at_once(*[lambda e=e: firsts.append(edit_log.append_edits(log, e)) for e in edits])
    rows = edit_log.read_queue(spark, log).collect()
    assert len(rows) == len({r.seq for r in rows}) == 35 and len(set(firsts)) == 5
    later = edit_log.append_edits(log, edits[0])
    assert later > max(r.seq for r in rows)
    own = spark.createDataFrame([("z", "tags", "x", "2024-01-01", 10**15)], EDIT + ", seq long")
    edit_log.append_edits(log, own)
    assert edit_log.append_edits(log, edits[0]) > 10**15
    # a log that was written before there were claims
    old = str(tmp_path / "old")
    own.selectExpr("table_name", "cast(null as string) column_name", "field", "value", "cast(edited_at as timestamp_ntz) edited_at", "seq").write.parquet(old)
    assert edit_log.append_edits(old, edits[0]) == 10**15 + 1


def queued(spark, log):
    return sorted((r.table_name, r.value) for r in edit_log.read_queue(spark, log).collect())


def test_an_append_between_read_and_clear_stays(spark, tmp_path):
    root, log = str(tmp_path / "cat"), str(tmp_path / "log")
    store.save_tables(spark.createDataFrame([(t, "gld", "2024") for t in "ab"], "table_name string, layer string, scanned_at string")
                      .selectExpr("*", *[f"cast(null as {t}) {c}" for c, t in (("row_count", "long"), ("column_count", "int"))],
                                  *[f"cast(null as string) {c}" for c in ("description", "business_owner", "source_system", "refresh_frequency",
                                                                         "tags", "updated_at", "updated_by")]), root)
    add = lambda *rows: edit_log.append_edits(log, spark.createDataFrame([(t, "tags", v, at) for t, v, at in rows], EDIT).coalesce(1))
    add(("a", "one", "2024-01-01"), ("b", "two", "2024-01-05"))
    applied = catalogue.apply_queued(spark, root, log, "N", up_to="2024-01-03T00:00:00")
    assert applied.queue.generation == -1 and store.state(spark, root).info["generation"] == -1
    add(("b", "late", "2024-01-02"))  # earlier than the cut-off, but not read
    after = catalogue.consume_queue(spark, log, applied)
    assert after.generation == 0 and queued(spark, log) == [("b", "late"), ("b", "two")]
    assert {r.table_name: r.tags for r in store.load_tables(spark, root).collect()} == {"a": "one", "b": None}
    applied = catalogue.apply_queued(spark, root, log, "N")
    add(("a", "three", "2024-01-09"))
    assert catalogue.consume_queue(spark, log, applied).generation == 1
    assert queued(spark, log) == [("a", "three")]
    assert {r.table_name: r.tags for r in store.load_tables(spark, root).collect()} == {"a": "one", "b": "two"}
    # nothing read any more is removed; the queue is what it was
    assert edit_log.vacuum_queue(spark, log, grace_hours=24) == 0
    assert edit_log.vacuum_queue(spark, log, grace_hours=0) == 3
    assert queued(spark, log) == [("a", "three")]
    catalogue.consume_queue(spark, log, catalogue.apply_queued(spark, root, log, "N"))
    assert queued(spark, log) == [] and edit_log.vacuum_queue(spark, log, 0) == 1
    assert catalogue.apply_queued(spark, root, log, "N").queue.files == ()


def test_two_clearings_of_overlapping_reads(spark, tmp_path):
    log = str(tmp_path / "log")
    add = lambda *rows: edit_log.append_edits(log, spark.createDataFrame([(t, "tags", t, "2024-01-01") for t in rows], EDIT).coalesce(1))
    add("a", "b", "c")
    early = edit_log.queue_state(spark, log)
    add("d", "e")
    late = edit_log.queue_state(spark, log)
    rows = edit_log.read_queue(spark, log, late)
    # one applied a and d, the other b; both clear, in either order nothing else goes
    edit_log.consume_queue(spark, log, late, rows.filter("table_name in ('a', 'd')"))
    edit_log.consume_queue(spark, log, early, edit_log.read_queue(spark, log, early).filter("table_name = 'b'"))
    assert queued(spark, log) == [("c", "c"), ("e", "e")]
    # all of an early read: rows that another clearing kept go, others stay
    edit_log.consume_queue(spark, log, early)
    assert queued(spark, log) == [("e", "e")]


def test_workflows_of_two_writers_both_count(spark, tmp_path, monkeypatch):
    """A refresh that a cleanup overtakes is computed again: the dropped table doesn't come back."""
    root = str(tmp_path)
    catalogue.refresh(spark, {"ref_a": spark.range(3).toDF("x"), "ref_b": spark.range(2).toDF("y")}, root, "2024-01-01T00:00:00")
    real, done = catalogue.preserve_tables, []

    def overtaken(scan, stored):
        if not done:
            done.append(1)
            catalogue.cleanup(spark, root, spark.createDataFrame([("ref_a",)], "table_name string"))
        return real(scan, stored)
    monkeypatch.setattr(catalogue, "preserve_tables", overtaken)
    catalogue.refresh(spark, {"ref_a": spark.range(4).toDF("x")}, root, "2024-01-02T00:00:00")
    assert [(r.table_name, r.row_count) for r in store.load_tables(spark, root).collect()] == [("ref_a", 4)]
    assert [r.column_name for r in store.load_columns(spark, root).collect()] == ["x"]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy of the repository without both llm folders, with and without the pipeline's file."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 50 and 'pipeline' not in q; assert set(E.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_an_overtaken_change_is_not_written_before_it_is_computed_again(spark, tmp_path, monkeypatch):
    """the commit is checked against other writers first, so nothing is written in vain."""
    root, writes, overtaken, write = str(tmp_path / "s"), [], [], store._write
    monkeypatch.setattr(store, "_write", lambda df, root, name, *a: writes.append(name) or write(df, root, name, *a))
    store.write_snapshot(frame(spark, ("a", 1)), root, "f")

    def add(row):
        return lambda read: {"f": read("f").unionByName(frame(spark, row))}

    def late(read):
        now = add(("c", 3))(read)
        if not overtaken:
            overtaken.append(store.transact(spark, root, add(("b", 2))))
        return now
    at = store.transact(spark, root, late)
    assert sorted(map(tuple, store.read(spark, at, "f").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert writes == ["f"] * 3
