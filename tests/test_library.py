"""Stores, update runs, evaluation runs."""

import os

import pandas as pd
import pytest

from lodeweir.operators.stores import IndexStore, VectorStore
from lodeweir.plans.engine import Engine, Models, SearchOptions, tool_reranks
from lodeweir.plans.library import Collection, Library, check_cases, evaluate, repair_scope, resolve_targets

ENTRY = "space_name string, collection_id bigint, collection_name string, doc_id bigint, chunk_id bigint, active boolean, filepath string, title string, heading string, body string"


def embedder():
    return lambda texts: pd.Series([[float("alpha" in t), float("beta" in t), 0.1] for t in texts])


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}")
    make = lambda *r: spark.createDataFrame([("s", 1, "c", d, k, True, "", "", "", b) for d, k, b in r], ENTRY)
    store.put(make((1, 10, "alpha one"), (1, 11, "beta"), (2, 20, "alpha two")))
    held = lambda: {r.chunk_id for r in store.reader().postings.where("term = 'alpha'").collect()}
    assert held() == {10, 20}
    store.put(make((1, 10, "gamma")))
    assert held() == {20}
    store.delete(spark.createDataFrame([(2,)], "doc_id bigint"), "doc_id")
    assert held() == set()
    store.delete(spark.createDataFrame([(11,)], "chunk_id bigint"))
    assert {r.chunk_id for r in store.reader().lengths.collect()} == {10}


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}")
    make = lambda space, *r: spark.createDataFrame([(space, k, "m", v) for k, v in r], "space_name string, chunk_id bigint, model string, vector array<double>")
    store.put(make("a", (1, [1.0, 2.0]), (2, [1.0, 2.0])))
    with pytest.raises(ValueError):
        store.put(make("a", (3, [1.0])))
    store.defer("b", make("b", (4, [1.0])))
    store.defer("a", make("a", (5, [1.0])))
    with pytest.raises(ValueError):
        store.flush()
    assert sorted(store.waiting) == ["a", "b"]  # the one that failed, and what came behind it
    del store.waiting["a"]
    assert store.flush() == ["b"] and store.waiting == {}
    store.delete(spark.createDataFrame([(1,)], "chunk_id bigint"))
    assert {r.chunk_id for r in store.table.snapshot().collect()} == {2, 4} and store.models().count() == 2
    store.clear("a")
    store.put(make("a", (7, [1.0, 2.0, 3.0])))
    assert {r.chunk_id for r in store.table.snapshot().collect()} == {4, 7}


def test_update(spark, tmp_path, monkeypatch):
    docs, embed = tmp_path / "docs", embedder()
    docs.mkdir()
    (docs / "a.md").write_text("# Alpha\n\nalpha text here")
    (docs / "b.txt").write_text("beta words")
    (docs / "bad.txt").write_bytes(b"\xff\xfe")
    (docs / "broken.pdf").write_bytes(b"%PDF none")
    library = Library(spark, f"file://{tmp_path}/lib", [Collection(1, "s", "c", str(docs))])
    first = library.update(models=Models(embed))
    assert dict((d, n) for _, d, n in first.decisions) == {"new": 4} and first.indexed == 2 and first.embedded == 2 and first.replayed == 0
    assert {p for p, _ in first.errors} == {"bad.txt", "broken.pdf"}
    queries = spark.createDataFrame([(1, "alpha", None, None), (2, "beta", "s", ["c"])], "qid bigint, text string, space_name string, collections array<string>")
    found = library.engine(Models(embed)).search(queries, SearchOptions("auto", neighbors=0)).where("rank = 1").collect()
    assert {r.qid: r.path for r in found} == {1: "a.md", 2: "b.txt"}
    (docs / "b.txt").write_text("gamma words now")
    os.utime(docs / "b.txt", (2_000_000_000, 2_000_000_000))
    (docs / "a.md").unlink()
    with monkeypatch.context() as m:
        m.setattr(IndexStore, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            library.update()
    again = library.update(models=Models(embed))  # what was left dirty is replayed
    assert again.replayed == 2 and again.embedded == 1
    rows = {r.path: r for r in library.documents.snapshot().collect()}
    assert not rows["a.md"].active and rows["a.md"].deactivated_at and rows["b.txt"].active and not rows["b.txt"].fts_dirty
    got = {(r.qid, r.path) for r in library.engine().search(queries, SearchOptions("keyword")).collect()}
    assert got == set()  # inactive, and another text
    assert library.empty_hint() is None and "no collections" in library.empty_hint("t")
    one = spark.createDataFrame([(1, "gamma", None, None)], queries.schema)
    hits = library.engine().search(one, SearchOptions("keyword", neighbors=0)).collect()
    hits = spark.createDataFrame([(r.qid, r.rank, r.space_name, r.collection_name, r.path) for r in hits], "qid bigint, rank bigint, space_name string, collection_name string, path string")

    def search(cases, opt):
        if opt.mode == "deep":
            raise ValueError("no model")
        return hits

    report, failures = evaluate(library.engine(), one, spark.createDataFrame([(1, "s/c/b.txt", 2)], "qid bigint, path string, relevance int"), search=search)
    assert set(failures) == {"deep", "deep+rerank"} and {r.mode: r.mrr for r in report.collect()} == {"keyword": 1.0, "auto": 1.0}
    assert check_cases(queries, library.entries()) == [] and len(check_cases(queries.selectExpr("qid", "'t' as space_name", "collections"), library.entries())) == 2


def test_scopes_and_notices(spark):
    a, b, c = (Collection(i, s, n, "/") for i, s, n in ((1, "x", "a"), (2, "x", "b"), (3, "y", "a")))
    assert resolve_targets([a, b, c], [(None, "b"), ("x", "b"), ("y", "a")]) == [b, c] and resolve_targets([a], None) == [a]
    for wrong in ((None, "a"), ("x", "zz")):
        with pytest.raises(ValueError):
            resolve_targets([a, b, c], [wrong])
    assert repair_scope([a, b, c], [a, b], False) == ("spaces", ["x"]) and repair_scope([a, b, c], [a], False) == ("collections", [1]) and repair_scope([a], [a], False)[0] == "global"
    engine = Engine(spark, spark.createDataFrame([("s", 1, "c", 1, 1, True, "", "", "", "b")], ENTRY).withColumnRenamed("title", "doc_title").selectExpr("*", "body as text", "'' as retrieval_prefix"))
    p = engine.pipeline(SearchOptions("auto"))
    assert p.notices == [("dense", "not configured")] and p.effective_mode("auto") == "keyword" and not p.dense
    assert [n for n, _ in engine.pipeline(SearchOptions("deep")).notices] == ["dense", "expansion", "rerank"]
    assert tool_reranks("deep") and not tool_reranks("auto") and tool_reranks("auto", False)
