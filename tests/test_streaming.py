"""Refreshes in batch and as a stream, and the scheduler."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from lodeweir.streaming import watch as W


def test_batch_and_stream_agree_with_the_fold(spark, tmp_path):
    rng = random.Random(3)
    t0 = datetime(2025, 1, 1)
    rows = sorted((rng.choice("ab"), t0 + timedelta(seconds=rng.randint(0, 2000))) for _ in range(120))
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    want = sorted((k, d, f, n) for k in "ab" for d, f, n in W.fold_due(sorted(int(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000) for kk, t in rows if kk == k), 30_000_000, 100_000_000))
    us = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    got = sorted((r.k, us(r.due), us(r.first_event), r.events) for r in W.due_refreshes(df, "k", "ts", 30_000, 100_000).collect())
    assert got == want and sum(r[3] for r in got) == 120
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    far = spark.createDataFrame([("z", t0 + timedelta(days=1))], "k string, ts timestamp")
    far.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = W.due_refreshes_stream(spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", "ts", 30_000, 100_000)
    q = stream.writeStream.format("memory").queryName("due").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, us(r.due), us(r.first_event), r.events) for r in spark.sql("select * from due where k <> 'z'").collect()) == want


def test_scheduler():
    s, t, u = W.RefreshScheduler(), ("work", "notes"), ("work", "old")
    s.mark_dirty(t, 0)
    assert not s.due(29_999, {}) and s.due(30_000, {}) == [("keyword", t)]
    for now in range(10_000, 300_000, 10_000):
        s.mark_dirty(t, now)
    assert not s.keyword_due(t, 299_999) and s.keyword_due(t, 300_000)
    s.update_error(t, 300_000)
    assert not s.keyword_due(t, 359_999) and s.keyword_due(t, 360_000)
    s.keyword_success(t, 400_000, started=390_000)
    assert not s.dirty and not s.due(699_999, {t: 3}) and s.due(700_000, {t: 3}) == [("semantic", t)] and not s.due(700_000, {t: 0})
    s.semantic_unavailable(t, 700_000)
    assert not s.semantic_due(t, 1_299_999, 1) and s.semantic_due(t, 1_300_000, 1)
    s.semantic[u] = 0
    s.space_blocked("work", 1_300_000)
    assert not s.due(4_899_999, {t: 1, u: 1}) and s.due(4_900_000, {t: 1, u: 1}) == [("semantic", t)]
    s.semantic_success(t)
    assert s.due(4_900_000, {u: 1}) == [("semantic", u)]


def test_schedules(spark):
    assert [W.normalize_time(x) for x in ("9am", "12:30 AM", "12pm", "23:05", "7:00 p.m.")] == ["09:00", "00:30", "12:00", "23:05", "19:00"]
    for bad in ("25:00", "13pm", "9", "x"):
        with pytest.raises(ValueError):
            W.normalize_time(bad)
    with pytest.raises(ValueError):
        W.normalize_interval(4)
    schedules, a = W.add_schedule([], "daily 09:00", ["x"])
    schedules, b = W.add_schedule(schedules, "daily 10:00", ["x"])
    assert (a, b, W.add_schedule(schedules, "daily 09:00", ["x", "x"])[1]) == ("s1", "s2", "s1")
    make = lambda r: spark.createDataFrame(r, "id string, trigger string")
    assert {r.id: r.status for r in W.schedule_status(make([("a", "1"), ("b", "1"), ("c", "1")]), make([("a", "1"), ("b", "2"), ("d", "1")])).collect()} == {"a": "installed", "b": "drifted", "c": "missing", "d": "orphan"}
    cat = lambda r: spark.createDataFrame(r, "space_name string, collection_name string, path string")
    assert {r.collection_name: r.change for r in W.sync_catalog(cat([("s", "a", "1"), ("s", "b", "1"), ("s", "c", "1")]), cat([("s", "a", "1"), ("s", "b", "2"), ("s", "d", "1")])).collect()} == {"b": "path_changed", "c": "removed", "d": "added"}


def test_watcher():
    ran = []

    def update(t):
        ran.append(("k", t))
        if t == ("s", "b") and len(ran) < 3:
            raise OSError("busy")

    a, b = ("s", "a"), ("s", "b")
    w = W.Watcher({a: "/r/a", b: "/r/a/deep"}, update, lambda t: ran.append(("e", t)), scan=lambda: [b])
    assert w.route("/r/a/x.md") == a and w.route("/r/a/deep/y.md") == b and w.route("/r/a/node_modules/z.md") is None and w.route("/q") is None and w.route("/r/a/Cargo.lock") is None
    rng = random.Random(1)
    w.events(["/r/a/x.md"], 0)
    assert w.tick(0, {}, rng) == [] and 2_700_000 <= w.next_scan <= 4_500_000  # the scan at the start finds b
    assert w.tick(30_000, {}, rng) == [("keyword", a), ("keyword", b)] and w.last_error == "busy"
    assert w.tick(60_000, {}, rng) == [] and w.tick(90_000, {}, rng) == [("keyword", b)]  # a minute later
    assert w.tick(30_000 + 300_000, {a: 2}, rng) == [("semantic", a)] and ran[-1] == ("e", a)
    w.events(None, 500_000)
    assert not w.native and sorted(w.scheduler.dirty) == [a, b]
    w.next_scan = 600_000
    w.tick(600_000, {}, rng)
    assert w.next_scan == 900_000


def test_run_schedule():
    saved, times = [], iter("abcdefgh")

    class Lock:
        free = 0

        def release(self):
            Lock.free += 1

    run = lambda job, lock: W.run_schedule(job, lock, saved.append, lambda: next(times))
    assert run(lambda: 1, Lock)["last_result"] == "success" and Lock.free == 1 and saved[0]["last_finished"] is None
    assert run(lambda: 1, lambda: None)["last_result"] == "skipped_lock"
    with pytest.raises(ZeroDivisionError):
        run(lambda: 1 // 0, Lock)
    assert saved[-1]["last_result"] == "failed" and Lock.free == 2 and saved[-1]["last_finished"] == "f"


def test_gateway():
    import json

    import pandas as pd

    from lodeweir.plans import gateway as g

    answers, waits, restarts = [], [], []

    def send(url, body):
        x = answers.pop(0) if answers else None
        if isinstance(x, Exception):
            raise x
        if x:
            return x
        if url.endswith("embeddings"):
            return 200, {}, json.dumps({"data": [{"index": i, "embedding": [len(t)]} for i, t in enumerate(body["input"])][::-1]}).encode()
        if url.endswith("rerank"):
            return 200, {}, json.dumps({"results": [{"index": i, "relevance_score": len(t) - 1} for i, t in enumerate(body["documents"])]}).encode()
        return 200, {}, json.dumps({"choices": [{"message": {"content": "- Other words\n QUERY \nother  words\nmore"}}]}).encode()

    e = g.Endpoint("http://h/v1/", send, 1, lambda: restarts.append(1), waits.append)
    assert e.url("embeddings") == "http://h/v1/embeddings" and g.Endpoint("http://h/rerank", send).url("/rerank") == "http://h/rerank"
    answers += [(429, {"retry-after": "99"}, b"")]
    texts = pd.Series(["x" * i for i in range(1, 150)])
    assert [v[0] for v in g.embedder(e, parallel=2)(texts)] == list(range(1, 150)) and waits == [30]
    answers += [OSError("gone"), OSError("gone")]
    assert e.ready() == "ready" and restarts == [1]
    answers += [(400, {}, b"no")]
    assert "400" in e.ready()
    answers += [(503, {}, b""), (503, {}, b"")]
    with pytest.raises(g.EndpointError):
        e.post("embeddings", {})
    assert g.reranker(e, 2)(pd.Series(["q", "p", "q"]), pd.Series(["a", "bb", "ccc"])).tolist() == [0.0, 1.0, 1.0]
    assert g.expander(g.completion(e))("query", 4) == ["Other words", "more"]
    with pytest.raises(g.EndpointError):
        g.in_shards([1, 2, 3], 2, lambda part: [])
    assert g.in_shards([], 2, list) == []
