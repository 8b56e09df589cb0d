"""Ideal-point ranking."""

import math
import random

import pytest

from lodeweir.llm.rank import ideal_point_ranking, ranking_quality, split_rank

SCHEMA = "search_id bigint, chunk_id bigint, bm25 double, dense double, reranker double, final_score double, rank int, closeness double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, 1, 0.0) for r in rows], SCHEMA)


def order(df, search=1):
    return [r.chunk_id for r in df.where(f"search_id = {search}").orderBy("rank").collect()]


def test_no_range_prevails(spark):
    rows = [(1, 1, 1000.0, 0.1, 0.1), (1, 2, 900.0, 0.9, 0.9), (1, 3, 10.0, 0.2, 0.2), (1, 4, 0.0, 0.0, 0.0)]
    assert order(ideal_point_ranking(frame(spark, rows)))[0] == 2
    scaled = [(s, c, b / 1e6, d * 1e3, r) for s, c, b, d, r in rows]
    assert order(ideal_point_ranking(frame(spark, scaled))) == order(ideal_point_ranking(frame(spark, rows)))
    shifted = [(s, c, b - 500, d - 7, r) for s, c, b, d, r in rows]
    assert order(ideal_point_ranking(frame(spark, shifted))) == order(ideal_point_ranking(frame(spark, rows)))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 5, None, None, None), (2, 9, 3.0, None, None), (2, 8, 3.0, None, None), (2, 8, 3.0, None, None),  # one candidate; constant, repeated
        (3, 1, nan, inf, None), (3, 2, 2.0, 0.5, None), (3, 3, 1.0, 0.4, None), (None, 1, 1.0, 1.0, 1.0), (4, None, 1.0, 1.0, 1.0),
    ]
    out = ideal_point_ranking(frame(spark, rows))
    got = {(r.search_id, r.chunk_id): (r.rank, r.closeness) for r in out.collect()}
    assert got[1, 5] == (1, 0.5) and got[2, 8] == (1, 0.5) and got[2, 9] == (2, 0.5) and len(got) == 6
    assert got[3, 2] == (1, 1.0) and got[3, 1] == (2, 0.5) and got[3, 3] == (3, 0.0)
    assert ideal_point_ranking(frame(spark, [])).count() == 0


def test_outliers_are_winsorised(spark):
    rows = [(1, i, float(i), 1 - i / 10, None) for i in range(10)] + [(1, 99, 1e9, 0.0, None)]
    out = {r.chunk_id: r.closeness for r in ideal_point_ranking(frame(spark, rows)).collect()}
    assert out[9] > 0.3 and out[0] > 0.3  # the outlier leaves the others apart


@pytest.mark.parametrize("hot", [1, 10**6])
def test_split_rank(spark, hot):
    rng = random.Random(1)
    rows = [(g, rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]), i * 40_000) for i, g in enumerate([1, 2] * 60)]
    got = {(r.g, r.i): r.rank for r in split_rank(spark.createDataFrame(rows, "g bigint, v double, i bigint"), "g", "v", "i", hot).collect()}
    for g in (1, 2):
        want = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in want] == list(range(1, len(want) + 1))


def test_quality(spark):
    rows = [(1, 1, 5.0, 5.0, None), (1, 2, 1.0, 1.0, None), (2, 3, 1.0, None, None)]
    c = frame(spark, rows)
    g = spark.createDataFrame([(1, 1, 3), (1, 2, 0), (2, 3, 0), (1, 1, 3), (None, 1, 3)], "search_id bigint, chunk_id bigint, grade int")
    q = {r.ordering: (r.searches, r.ndcg) for r in ranking_quality(c, g, ideal_point_ranking(c)).collect()}
    assert q["ideal_point"] == (1, 1.0) and q["final_score"][0] == 1 and math.isclose(q["final_score"][1], 1.0)
