"""Changes of catalogue tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeweir.operators import maintenance as M

SPACES = "space_id bigint, name string, description string, created timestamp"


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_spaces(spark):
    s = spark.createDataFrame([(1, "default", None, datetime(2025, 1, 1)), (2, "work", None, None)], SPACES)
    more = M.create_space(s, "home", "d")
    assert names(more) == ["default", "home", "work"] and more.where("name = 'home'").first().space_id == 3
    with pytest.raises(ValueError):
        M.create_space(s, "work")
    c = spark.createDataFrame([(10, 1, "notes", None), (11, 2, "notes", None)], "collection_id bigint, space_id bigint, collection_name string, removed_at timestamp")
    left, cols = M.delete_space(s, c, "default")
    assert names(left) == ["default", "work"] and [r.collection_id for r in cols.collect()] == [11]
    assert names(M.delete_space(s, c, "work")[0]) == ["default"]
    assert names(M.rename(s, F.col("name") == "work", "name", "job")) == ["default", "job"]
    with pytest.raises(ValueError):
        M.rename(s, F.col("name") == "work", "name", "default")
    assert M.describe(s, F.col("name") == "work", "x").where("description = 'x'").count() == 1
    with pytest.raises(ValueError):
        M.create_collection(c, spark.createDataFrame([(12, 2, "notes")], "collection_id bigint, space_id bigint, collection_name string"))
    assert M.create_collection(c, spark.createDataFrame([(12, 2, "more")], "collection_id bigint, space_id bigint, collection_name string")).count() == 3


def test_snapshot(spark):
    d = spark.createDataFrame([(1, 5, True), (2, 6, False)], "doc_id bigint, collection_id bigint, fts_dirty boolean")
    c = spark.createDataFrame([(10, 1, 0, 1, "a"), (20, 2, 0, 1, "b")], "chunk_id bigint, doc_id bigint, byte_offset bigint, byte_length bigint, text string")
    e = spark.createDataFrame([(10,), (20,)], "vec_id bigint")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    s = M.Snapshot(d, c, e, t)
    left = s.without_collections(d.where("collection_id = 5"))
    assert [x.count() for x in (left.documents, left.chunks, left.embeddings, left.texts)] == [1, 1, 1, 1] and left.embeddings.first().vec_id == 20
    new = s.replace_generation(spark.createDataFrame([(1, 5, True)], d.schema), spark.createDataFrame([(1, "xyé")], t.schema), spark.createDataFrame([(11, 1, 2, 2, "é")], c.schema))
    assert sorted(r.chunk_id for r in new.chunks.collect()) == [11, 20] and [r.vec_id for r in new.embeddings.collect()] == [20]
    with pytest.raises(ValueError):
        s.replace_generation(spark.createDataFrame([(1, 5, True)], d.schema), spark.createDataFrame([(1, "xyé")], t.schema), spark.createDataFrame([(11, 1, 3, 1, "?")], c.schema))
    assert M.clear_dirty(d, d.where("doc_id = 1")).where("fts_dirty").count() == 0
    assert [r.chunk_id for r in M.keyset_page(c, "chunk_id", 10, 5).collect()] == [20]


def test_models(spark):
    ok, bad = M.preflight(spark.createDataFrame([(1, 1, "a b"), (2, 1, "a b c"), (3, 2, None)], "chunk_id bigint, doc_id bigint, text string"), 2)
    assert [r.doc_id for r in ok.collect()] == [2] and [r.chunk_id for r in bad.collect()] == [2]
    led = spark.createDataFrame([("s", 1, "m"), ("s", 2, "m"), ("t", 3, "old")], "space_name string, chunk_id bigint, model string")
    vec = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3), ("u", 4)], "space_name string, chunk_id bigint")
    assert {r.space_name: r.repair for r in M.dense_repair(led, vec, "m").collect()} == {"s": False, "t": True, "u": True}
    assert M.shard_ranges(7, 3) == [(0, 3), (3, 5), (5, 7)] and M.shard_ranges(0, 3) == []
    assert M.checked_scores([(1, 2.0), (0, -1.0)], 2) == [0.0, 1.0]
    for wrong in ([(0, 1.0)], [(0, 1.0), (1, float("nan"))], [(0, 1.0), (0, 1.0)]):
        with pytest.raises(ValueError):
            M.checked_scores(wrong, 2)
