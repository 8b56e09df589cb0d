"""Near-duplicates against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeweir.llm import queries
from lodeweir.llm.neardup import expand_pairs, near_duplicate_groups, near_duplicate_links

SCHEMA = "response_id bigint, content string, path string, class_id string, grams string"


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(25, 80))] for _ in range(25)]
    rows, k = [], 0
    for words in base:
        for _ in range(rng.randint(1, 6)):
            v = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            k += 1
            rows.append((k, " ".join(v) + rng.choice(["", "!", "\n"])))
    return rows


def brute(rows, threshold=0.7):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if k is not None and len(w) >= 30:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def run(spark, rows, expand=2000, **kw):
    df = spark.createDataFrame([(k, t, "p", "c", "g") for k, t in rows], SCHEMA)
    members, links = near_duplicate_links(df, "response_id", "content", **kw)
    return {tuple(r) for r in expand_pairs(members, links, "response_id", expand).collect()}, members, links


@pytest.mark.parametrize("block", [2000, 2])
def test_all_pairs(spark, block):
    rows = corpus()
    rows += [(1000, "Short text"), (1001, None), (None, rows[0][1]), (1002, ""), rows[0], (1003, rows[0][1].upper()), (1004, "ß _ " * 40), (1005, "same " * 50), (1006, "same " * 90), (1007, "x y " * 20_000)]
    got, members, links = run(spark, rows, block_sets=block)
    want = brute(rows)
    assert got == want and len(want) > 30
    groups = {r.response_id: r.group_id for r in near_duplicate_groups(members, links, "response_id").collect()}
    parent = {k: k for k in groups}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    by = {}
    for k in groups:
        by.setdefault(root(k), set()).add(groups[k])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_large_groups_of_copies_are_stars(spark):
    text = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"a{i}" for i in range(39)) + " z"
    rows = [(i, text) for i in range(1, 8)] + [(20, other), (21, other)]
    got, *_ = run(spark, rows, expand=3)
    assert {(1, i) for i in range(2, 8)} | {(20, 21), (1, 20), (1, 21)} == got
    assert run(spark, rows)[0] == brute(rows)


def test_different_texts_of_one_set_are_all_paired(spark):
    words = [f"a{i}" for i in range(40)]
    rows = [(i, " ".join(words[:i]).upper() + "; " + " ".join(words[i:])) for i in range(1, 12)] + [(30 + i, " ".join(words[:39]) + " z" + "!" * i) for i in range(5)]
    assert run(spark, rows, expand=3)[0] == brute(rows) and len(brute(rows)) == 16 * 15 // 2
    rows += [(50 + i, rows[0][1]) for i in range(4)]  # five of one content: the representative stands for them
    assert run(spark, rows, expand=3)[0] == {p for p in brute(rows) if max(p) < 50} | {(1, 50 + i) for i in range(4)}


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_blocks_of_classes(spark, block):
    rows = corpus() + [(1000 + i, corpus()[0][1] + "." * (i % 7)) for i in range(20)]
    _, members, links = run(spark, rows)
    got = [tuple(r) for r in expand_pairs(members, links, "response_id", block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_classes_lose_no_pair(spark, tmp_path):
    text = " ".join(f"a{i}" for i in range(40))
    n = 2001
    same = spark.range(1, n + 1).select(F.col("id").alias("response_id"), F.concat(F.lit(text), F.expr("repeat('!', cast(id % 5 as int))")).alias("content"))
    other = spark.createDataFrame([(5000, text.rsplit(" ", 1)[0] + " z")], "response_id bigint, content string")
    same.unionByName(other).write.parquet(f"{tmp_path}/document_responses.parquet")
    out = queries.QUERIES["p5_found"](spark, str(tmp_path))
    assert out.count() == out.distinct().count() == n * (n - 1) // 2 + n
    assert out.where("response_a >= response_b").count() == 0


def test_empty(spark):
    got, members, links = run(spark, [])
    assert got == set() and near_duplicate_groups(members, links, "response_id").count() == 0
