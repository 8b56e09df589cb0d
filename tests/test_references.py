"""Runs, as-of matches and orphan references."""

import random
from datetime import datetime, timedelta

import pytest

from lodeweir.operators import references as R

T0 = datetime(2025, 1, 1)


@pytest.mark.parametrize("width", [2, 4, 1 << 16])
def test_contiguous_runs(spark, width):
    rng = random.Random(width)
    keys = {rng.randint(-40, 60) for _ in range(60)}
    df = spark.createDataFrame([(k, "x") for k in [*keys, *keys]] + [(None, "x")], "id bigint, run_start string")
    got = sorted((r.run_start, r.run_end) for r in R.contiguous_runs(df.select("id"), "id", width=width).collect())
    want = []
    for k in sorted(keys):
        if want and want[-1][1] == k - 1:
            want[-1] = (want[-1][0], k)
        else:
            want.append((k, k))
    assert got == want


@pytest.mark.parametrize("width", [3, 1000])
def test_match_against_brute_force(spark, width):
    rng = random.Random(width)
    runs = [(g, s, s + rng.randint(-1, 6)) for g in "ab" for s in rng.sample(range(-50, 50), 9)]
    refs = [(g, rng.randint(-60, 60)) for g in "abc" for _ in range(40)]
    got = {(r.g, r.k) for r in R.missing_keys(spark.createDataFrame(refs, "g string, k bigint"), spark.createDataFrame(runs, "g string, run_start bigint, run_end bigint"), "k", ["g"], width).collect()}
    want = set()
    for g, k in refs:
        before = [r for r in runs if r[0] == g and r[1] <= k]
        if not before or k > max(before, key=lambda r: (r[1], r[2]))[2]:
            want.add((g, k))
    assert got == want


COLS = "collection_id bigint, space_id bigint, space_name string, collection_name string, created timestamp, removed_at timestamp, t string, path string"
ROWS = "row_id bigint, doc_id bigint, collection_id bigint, path string, active boolean, recorded_at timestamp, t string, run_start string"
CASES = "case_id bigint, space_name string, path string"
JUDGED = "judgment_id bigint, case_id bigint, path string, judged_at timestamp, seg string, space_name string"


def at(d):
    return T0 + timedelta(days=d)


def frames(spark, cols, rows, cases, judged):
    c = [(*x, "", "") for x in cols]
    r = [(*x, "", "") for x in rows]
    return spark.createDataFrame(r, ROWS), spark.createDataFrame(c, COLS), spark.createDataFrame([(*x, "") for x in judged], JUDGED), spark.createDataFrame([(*x, "") for x in cases], CASES)


@pytest.mark.parametrize("small", [10_000, 0])
def test_orphans(spark, monkeypatch, small):
    monkeypatch.setattr(R, "SMALL_RUNS", small)
    cols = [(1, 1, "work", "notes", at(0), None), (2, 1, "work", "old", at(0), at(10)), (2, 1, "work", "old", at(0), at(10)), (5, 2, "home", "notes", at(5), None)]
    rows = [
        (1, 1, 1, "a.md", True, at(1)), (2, 1, 2, "b.md", True, at(9)), (3, 1, 2, "b.md", True, at(10)), (4, 1, 3, "c.md", True, at(1)), (5, 1, 5, "d.md", True, at(4)),
        (6, 1, None, "e.md", True, at(1)), (7, 1, 9, "f.md", True, at(1)), (7, 1, 9, "f.md", True, at(1)), (8, 1, 1, "a.md", False, at(8)), (9, 2, 1, "x/ü.md", True, at(2)), (10, 1, 1, None, None, None),
    ]
    cases = [(1, "work"), (2, None)]
    judged = [
        (1, 1, "notes/a.md", at(2), ""), (2, 1, "  .\\notes\\\\a.md ", at(3), ""), (3, 1, "notes/a.md", at(8), ""), (4, 1, "notes/a.md", at(0), ""), (5, 2, "work/notes/x/./ü.md", at(3), ""),
        (6, 2, "notes/a.md", at(2), ""), (7, 1, "Notes/a.md", at(2), ""), (8, 1, None, at(2), ""), (9, 1, "old/b.md", at(9), ""), (10, 1, "old/b.md", at(10), ""), (11, 1, "   ", at(2), ""), (11, 1, "   ", at(2), ""),
        (12, 77, "work/notes/a.md", at(2), ""), (13, 1, "notes/a.md", None, ""),
    ]
    found = R.orphan_references(*frames(spark, cols, rows, cases, [(j, c, p, t, s) for j, c, p, t, s in judged]))
    got = sorted((r.ref_table, r.ref_id) for r in found.collect())
    assert got == [("document_rows", i) for i in (3, 4, 5, 7)] + [("eval_judgments", i) for i in (3, 4, 6, 7, 10, 11)]
    months = {(r.ref_table, r.month): r.orphans for r in R.orphans_by_month(found).collect()}
    assert months == {("document_rows", "2025-01"): 4, ("eval_judgments", "2025-01"): 6}


@pytest.mark.parametrize("small", [10_000, 0])
def test_rows_are_matched_to_merged_lifetimes(spark, monkeypatch, small):
    monkeypatch.setattr(R, "SMALL_RUNS", small)
    keys, match = [], R.missing_keys
    monkeypatch.setattr(R, "missing_keys", lambda refs, runs, key, group, width: keys.append(key) or match(refs, runs, key, group, width))
    cols = [(1, 1, "s", "a", at(0), at(10)), (1, 1, "s", "b", at(5), at(7)), (1, 1, "s", "c", at(10), at(12)), (1, 1, "s", "d", at(20), None), (1, 1, "s", "e", at(30), at(31)), (2, 1, "s", "f", at(9), at(3)), (3, 1, "s", "g", None, None)]
    times = [(1, d) for d in (-1, 0, 6, 8, 10, 11, 12, 19, 20, 32, 99)] + [(2, 5), (2, 9), (3, 5), (4, 5)]
    rows = [(k, 1, c, "p", True, at(d)) for k, (c, d) in enumerate(times)]
    found = R.orphan_document_rows(*frames(spark, cols, rows, [], [])[:2]).collect()
    assert {times[r.ref_id] for r in found} == {(1, -1), (1, 12), (1, 19), (2, 5), (2, 9), (3, 5), (4, 5)}
    assert {times[r.ref_id] for r in found if r.reason == "never existed"} == {(4, 5)} and keys == ["collection_id", "t"]


def test_orphans_of_empty_tables(spark):
    assert R.orphan_references(*frames(spark, [], [], [], [])).count() == 0
    found = R.orphan_references(*frames(spark, [], [(1, 1, 1, "a", True, at(1))], [], [(1, 1, "a/b", at(1), "")]))
    assert found.count() == 2
