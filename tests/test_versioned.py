"""Versioned tables, record deltas and pending documents."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeweir.operators.pending import PendingState, incremental_pending, pending_documents
from lodeweir.session import fresh_path
from lodeweir.sources.versioned import CommitConflict, VersionedTable, process_changes

T0 = datetime(2025, 1, 1)


def table(spark, name="t"):
    return VersionedTable(spark, fresh_path(spark, name), spark.createDataFrame([], "k bigint, v string").schema)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_changes_follow_manifests(spark):
    t = table(spark)
    assert t.latest() == 0 and t.snapshot().count() == 0
    t.append(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, v string"))
    new = spark.createDataFrame([(2, "B", True), (3, "c", True), (4, "d", True), (1, None, False)], "k bigint, v string, here boolean")
    t.merge(new, "k", unchanged=lambda o, n: F.col(f"{o}.v") == F.col(f"{n}.v"), present=F.col("here"))
    assert rows(t.snapshot()) == [(2, "B"), (3, "c"), (4, "d")]
    assert rows(t.snapshot(1)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(t.changes(1)) == [(1, "a", "removed"), (2, "B", "added"), (2, "b", "removed"), (4, "d", "added")]
    assert t.changes(2).count() == 0
    live, _ = t.state(2)
    t.replace_files(sorted(live), t.snapshot())
    assert rows(t.snapshot()) == [(2, "B"), (3, "c"), (4, "d")]
    assert rows(t.changes(1, 2)) == [(1, "a", "removed"), (2, "B", "added"), (2, "b", "removed"), (4, "d", "added")]


def test_two_writers_of_one_version(spark):
    t = table(spark)
    t.append(spark.createDataFrame([(1, "a")], "k bigint, v string"))
    with pytest.raises(CommitConflict):
        t._commit(1, [], [], [], {})
    assert t.versions() == [1]


def test_failed_runs_neither_skip_nor_repeat(spark):
    source, out = table(spark, "s"), table(spark, "o")
    add = lambda *r: source.append(spark.createDataFrame(list(r), "k bigint, v string"))
    step = lambda d: d.where("change = 'added'").drop("change")
    add((1, "a"))
    assert process_changes(source, out, step) == 1
    assert process_changes(source, out, step) is None
    add((2, "b"))
    add((3, "c"))

    def broken(d):
        bad = F.udf(lambda v: 1 // 0, "string")
        return step(d).withColumn("v", bad("v"))

    with pytest.raises(Exception):  # noqa: B017
        process_changes(source, out, broken)
    assert rows(out.snapshot()) == [(1, "a")]
    process_changes(source, out, step)
    assert rows(out.snapshot()) == [(1, "a"), (2, "b"), (3, "c")]
    assert out.properties()["processed.source"] == 3


ROWS = "row_id bigint, doc_id bigint, hash string, fts_dirty boolean, active boolean, recorded_at timestamp, status string, ok string"
RUNS = "run_id bigint, status string, checkpoint_seq bigint"
ITEMS = "run_id bigint, item_seq bigint, doc_id bigint, hash string, outcome string, processed_at timestamp, ok boolean"


def at(h):
    return T0 + timedelta(hours=h)


def test_pending_documents(spark):
    r = [
        (1, 1, "a", False, True, at(1), "x", "y"), (2, 1, "b", False, True, at(5), "x", "y"),  # changed since
        (3, 2, "c", False, True, at(1), "x", "y"), (3, 2, "c", False, True, at(1), "x", "y"),  # done, repeated
        (4, 3, "d", True, True, at(9), "x", "y"),  # full text dirty after processing
        (5, 4, "e", True, True, at(1), "x", "y"),  # dirty before processing
        (6, 5, "f", False, False, at(1), "x", "y"),  # inactive
        (7, 6, "g", False, True, at(1), "x", "y"),  # only failed
        (8, 7, "h", False, True, at(1), "x", "y"),  # beyond the checkpoint
        (9, 8, "i", False, True, at(1), "x", "y"),  # below it
        (10, None, "j", False, True, at(1), "x", "y"), (11, 9, None, None, True, at(1), "x", "y"), (12, 10, "k", None, None, at(1), "x", "y"),
        (13, 11, "l", False, True, at(1), "x", "y"),  # null checkpoint
    ]
    runs = [(1, "succeeded", None), (1, "succeeded", None), (2, "failed", 2), (3, "aborted", None)]
    items = [
        (1, 1, 1, "a", "done", at(2), True), (1, 2, 2, "c", "done", at(2), True), (1, 3, 3, "d", "skipped_hash", at(2), True), (1, 4, 4, "e", "done", at(2), True),
        (1, 5, 6, "g", "extract_failed", at(2), True), (2, 3, 7, "h", "done", at(2), True), (2, 2, 8, "i", "done", at(2), True), (2, 2, 8, "i", "done", at(2), True),
        (9, 1, 7, "h", "done", at(3), True), (3, 1, 11, "l", "done", at(2), None), (1, 9, None, "z", None, at(2), None),
    ]
    found = pending_documents(spark.createDataFrame(r, ROWS), spark.createDataFrame(runs, RUNS), spark.createDataFrame(items, ITEMS))
    assert rows(found, "doc_id") == [(d,) for d in (1, 3, 6, 7, 9, 11)]


def test_pending_of_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (ROWS, RUNS, ITEMS)]
    assert pending_documents(*empty).count() == 0
    one = spark.createDataFrame([(1, 1, "a", False, True, at(1), "", "")], ROWS)
    assert rows(pending_documents(one, *empty[1:]), "doc_id") == [(1,)]


def test_updates_read_added_files_and_survive_failures(spark, tmp_path, monkeypatch):
    def add(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/{name}.parquet")

    def run():
        return incremental_pending(spark, f"{tmp_path}/t", f"file://{tmp_path}/state")

    add("document_rows", [(1, 1, "a", False, True, at(1), "", ""), (2, 2, "b", False, True, at(1), "", "")], ROWS)
    add("update_runs", [(1, "running", None)], RUNS)
    add("update_items", [(1, 1, 1, "a", "done", at(2), True)], ITEMS)
    assert rows(run().pending(), "doc_id") == [(1,), (2,)]
    assert run().state.latest() == 1  # nothing added, nothing done
    add("update_runs", [(1, "succeeded", None)], RUNS)  # the waiting item becomes durable
    state = run()
    assert rows(state.pending(), "doc_id") == [(2,)] and state.state.properties()["touched"] == 1
    add("document_rows", [(3, 1, "c", False, True, at(5), "", ""), (4, 3, "d", False, True, at(5), "", "")], ROWS)

    def fails(self, *a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "merge", fails)
        with pytest.raises(OSError):
            run()
    assert rows(PendingState(spark, f"file://{tmp_path}/state/0").pending(), "doc_id") == [(2,)]
    state = run()
    assert rows(state.pending(), "doc_id") == [(1,), (2,), (3,)] and state.state.properties()["touched"] == 2
    removed = rows(state.state.changes(2).where("change = 'removed'"), "doc_id")
    assert removed == [(1,)]
    next(p for p in (tmp_path / "t/document_rows.parquet").iterdir() if p.name.startswith("part")).unlink()
    assert len(rows(run().pending(), "doc_id")) in (1, 2)  # a file is gone: the state is begun anew


def test_checkpoints(spark):
    t = table(spark)
    for k in range(12):
        t.append(spark.createDataFrame([(k, "v")], "k bigint, v string").coalesce(1), {"n": k})
    assert t._files(f"{t.root}/checkpoints", ".json") and t.properties()["n"] == 11
    assert rows(t.snapshot(), "k") == [(k,) for k in range(12)] and rows(t.changes(9), "k") == [(9,), (10,), (11,)]
