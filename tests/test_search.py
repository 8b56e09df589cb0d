"""Ranking operators on small vectors with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweir.operators import search as S


def lists(spark, kw, dense):
    make = lambda items: spark.createDataFrame([(1, c, float(s), i + 1) for i, (c, s) in enumerate(items)], "qid bigint, chunk_id bigint, score double, rank bigint")
    return make(kw), make(dense)


def order(df):
    return [r.chunk_id for r in df.orderBy("qid", "rank").collect()]


def test_rrf(spark):
    assert order(S.fuse_rrf(*lists(spark, [(10, 3), (20, 2)], [(20, 0.9), (30, 0.8)]))) == [20, 10, 30]


def test_linear(spark):
    assert order(S.fuse_linear(*lists(spark, [(10, 1.0), (20, 0.6)], [(30, 0.95), (10, 0.40)])))[0] in (10, 30)
    out = {r.chunk_id: r.score for r in S.fuse_linear(*lists(spark, [(10, 1.0), (20, 0.6)], [(30, 0.95), (10, 0.40)])).collect()}
    raw = {10: 0.7 * 0.40 / 0.95 + 0.3, 20: 0.3 * 0.6, 30: 0.7}
    assert all(math.isclose(out[k], v / max(raw.values()), abs_tol=1e-9) for k, v in raw.items())


def test_dbsf_orders_close_scores_below_one(spark):
    rows = S.fuse_dbsf(*lists(spark, [(1, 1.0), (2, 0.99), (3, 0.98)], [(1, 0.5), (2, 0.5), (3, 0.5)]), weights=(0.0, 1.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [1, 2, 3] and rows[0].score == 1.0 > rows[1].score > rows[2].score


def test_one_list_stays_unfused(spark):
    kw, dense = lists(spark, [(1, 8.0), (2, 4.0)], [(1, 1.0)])
    assert [(r.chunk_id, r.score) for r in S.fuse_dbsf(kw, dense.where("false")).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]


def test_variants(spark):
    ranked = spark.createDataFrame([(1, 0, 1, 10, 1.0, None), (1, 0, 2, 20, 1.0, None), (1, 1, 1, 10, 2.0, 0.5), (1, 1, 2, 40, None, 0.4), (1, 1, 3, 30, None, 0.3)], "qid bigint, variant int, rank bigint, chunk_id bigint, bm25 double, dense double")
    agg = S.aggregate_variants(ranked, k=1)
    final = S.finalize_variants(agg, 4).orderBy("rank").collect()
    assert final[0].chunk_id == 10 and final[-1].chunk_id == 30 and {r.chunk_id: r.original_rank for r in final} == {10: 1, 20: 2, 40: None, 30: None}
    few = S.finalize_variants(spark.createDataFrame([(1, 1, 9.0, None), (1, 2, 8.0, None), (1, 3, 1.0, 1)], "qid bigint, chunk_id bigint, score double, original_rank bigint"), 2)
    assert order(few) == [1, 3]
    assert S.select_variants([[1, 0], [0.99, 0.01], [0.98, 0.02], [0, 1]], 2) == [0, 1, 3]
    assert S.select_variants([[1, 0]], 2) == [0]


def test_representatives(spark):
    c = spark.createDataFrame([(1, 0, 10, 100, None), (1, 1, 20, 200, None), (1, 2, 30, 300, 1), (1, 3, 40, 400, 2), (1, 4, 10, 101, None)], "qid bigint, position bigint, doc_id bigint, chunk_id bigint, original_rank bigint")
    pick = lambda m, p: [r.chunk_id for r in S.rerank_representatives(c, m, p).orderBy("pick").collect()]
    assert pick(3, 2) == [300, 400, 100]
    assert pick(2, 0) == [100, 200]
    assert pick(2, 2) == [300, 400, 100]  # a cap met by protected documents admits one more


def test_apply_rerank(spark):
    c = spark.createDataFrame([(1, 0, 10, 100, 0.90), (1, 1, 20, 200, 1.0), (1, 2, 10, 101, 0.45), (1, 3, 30, 300, 0.30)], "qid bigint, position bigint, doc_id bigint, chunk_id bigint, fusion double")
    s = spark.createDataFrame([(1, 10, 0.80), (1, 20, 0.95)], "qid bigint, doc_id bigint, reranker double")
    out = {r.chunk_id: r.final_score for r in S.apply_rerank(c, s).collect()}
    assert out[200] == 1.0 and math.isclose(out[100], 1 / math.log2(3)) and math.isclose(out[101], out[100] / 2) and out[300] < out[101]


ENTRY = "space_name string, collection_id bigint, doc_id bigint, chunk_id bigint, active boolean, filepath string, title string, heading string, body string"


def entries(spark, bodies):
    return spark.createDataFrame([("s", 1, i, i, True, "", "", "", b) for i, b in bodies.items()], ENTRY)


def test_bm25_grows_with_frequency_and_ignores_scope(spark):
    index = S.TextIndex.build(entries(spark, {1: "alpha alpha alpha x y z", 2: "alpha b c d e f", 3: "alpha alpha w x y z", 4: "other words only"}))
    q = spark.createDataFrame([(1, "Alpha"), (2, "(+)-::///"), (3, "(+)- other")], "qid bigint, text string")
    free = {(r.qid, r.chunk_id): r.score for r in S.bm25_scores(q, index).collect()}
    assert free[1, 1] > free[1, 3] > free[1, 2] and not [k for k in free if k[0] == 2] and (3, 4) in free
    held = {(r.qid, r.chunk_id): r.score for r in S.bm25_scores(q, index, spark.createDataFrame([(1, 1), (1, 2)], "qid bigint, chunk_id bigint")).collect()}
    assert held == {k: v for k, v in free.items() if k in ((1, 1), (1, 2))}
    with pytest.raises(ValueError):
        S.bm25_scores(q, index, boosts={"nope": 1.0})
    q2 = q.withColumn("space_name", F.when(F.col("qid") == 1, "s").otherwise("t")).withColumn("collections", F.array().cast("array<string>"))
    inside = {(r.qid, r.chunk_id): r.score for r in S.bm25_scores(q2, index, scoped=True).collect()}
    assert inside == {k: v for k, v in free.items() if k[0] == 1}
    assert {r.chunk_id for r in S.bm25_scores(q, index.without(spark.createDataFrame([(1,)], "doc_id bigint"), "doc_id")).collect()} == {2, 3, 4}
    assert {r.chunk_id for r in S.bm25_scores(q, index.without(spark.createDataFrame([(1,)], "chunk_id bigint"))).collect()} == {2, 3, 4}


def test_knn(spark):
    v = spark.createDataFrame([(11, [1.0, 0.0]), (22, [0.0, 1.0]), (33, [0.0, 0.0]), (44, [0.0, None]), (55, None)], "chunk_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, vector array<double>")
    rows = S.knn_results(q, v, 4).orderBy("rank").collect()
    assert rows[0].chunk_id == 11 and rows[0].score == 1.0 and [r.similarity for r in rows[1:]] == [0.0, 0.0, 0.0]
    assert order(S.knn_results(q, v, 4, v.where("chunk_id = 22"))) == [22]
    assert order(S.knn_results(q, v.where("false"), 4)) == order(S.knn_results(q.where("false"), v, 4)) == []
    with pytest.raises(Exception, match="dimensions"):
        S.knn_results(q, spark.createDataFrame([(1, [1.0])], "chunk_id bigint, vector array<double>"), 4).collect()


def test_knn_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist(), f"s{i % 3}", f"c{i % 2}", i % 7 > 0) for i in range(200)]
    asked = [(i, rng.integers(-2, 3, 5).astype(float).tolist(), [None, "s1"][i % 2], [None, [], ["c0"], ["c0", "c1"]][i % 4]) for i in range(30)]
    v = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>, space_name string, collection_name string, active boolean").repartition(3)
    q = spark.createDataFrame(asked, "qid bigint, vector array<double>, space_name string, collections array<string>")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    want = {i: [r[0] for r in sorted((r for r in rows if r[4] and s in (None, r[2]) and (not c or r[3] in c)), key=lambda r: (-cos(x, r[1]), r[0]))[:8]] for i, x, s, c in asked}
    for block in (10_000, 7):
        monkeypatch.setattr(S, "QUERY_BLOCK", block)
        got = {}
        for r in S.knn_results(q, v, 8, scoped=True).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.chunk_id)
        assert got == want


def test_evaluation(spark):
    j = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "a", 0)], "qid bigint, path string, relevance int")
    run = lambda *paths: {r.qid: (r.ndcg, r.recall, r.mrr) for r in S.evaluation(spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(paths)], "qid bigint, rank bigint, path string"), j).collect()}
    assert run("a", "a", "b")[1] == (1.0, 1.0, 1.0)
    swapped = run("b", "a")[1]
    assert swapped[0] < 1.0 and swapped[1:] == (1.0, 1.0)
    assert run("x", "b")[1][2] == 0.5 and run("x")[2] == (0.0, 0.0, 0.0) and 3 not in run("x")


def test_ranking_plans_have_no_python(spark):
    kw, dense = lists(spark, [(1, 1)], [(2, 1)])
    plan = S.fuse_dbsf(kw, dense)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "WindowGroupLimit" in S.top_k(kw, 3, ["qid"], [F.desc("score")])._jdf.queryExecution().executedPlan().toString()
