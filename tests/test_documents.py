"""Extractors, canonical documents, chunks, files, evaluation sets, reads."""

import zlib

import pytest
from pyspark.sql import functions as F

from lodeweir.functions import text as T
from lodeweir.operators import catalog as C
from lodeweir.operators.chunking import ChunkPolicy, chunk_blocks, count_tokens, generation_key, resolve_policy, token_windows
from lodeweir.operators.extract import canonical, extract_documents, extractor_for, html_blocks, markdown_blocks, pdf_paragraphs, plaintext_blocks
from lodeweir.operators.reads import budgeted_take
from lodeweir.plans.engine import embed_backlog, get_documents, snippet
from lodeweir.sources import evalsets, files


def kinds(blocks):
    return [(b["kind"], b["text"]) for b in blocks]


def test_plaintext():
    _, b = plaintext_blocks("one\nstill\n \t\n\ntwo é\n")
    assert kinds(b) == [("Paragraph", "one\nstill"), ("Paragraph", "two é")] and b[1]["length"] == 6


def test_pdf_text():
    _, b = pdf_paragraphs("one  \r\ntwo\n \n\nthree")
    assert [(x["text"], x["offset"]) for x in b] == [("one\ntwo", 0), ("three", 9)]
    with pytest.raises(ValueError):
        pdf_paragraphs(" \n ")


def test_markdown():
    title, b = markdown_blocks("# Top\nintro\n\n## Sub\n- a\n- b\n  more\n\n> quote\n> two\n\n```py\ncode\n\nx\n```\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\nUnder\n=====\nlast")
    assert title == "Top"
    assert [k for k, _ in kinds(b)] == ["Heading", "Paragraph", "Heading", "ListItem", "ListItem", "BlockQuote", "CodeFence", "TableHeader", "TableRow", "Heading", "Paragraph"]
    assert b[3]["heading_path"] == ["Top", "Sub"] and b[6]["attrs"] == {"language": "py"} and b[6]["text"] == "code\n\nx" and b[-1]["heading_path"] == ["Under"]
    text, c = canonical(b)
    assert all(text.encode()[x["offset"] : x["offset"] + x["length"]].decode() == x["text"] for x in c)
    assert "| h | i |\n| 1 | 2 |" in text


def test_html():
    page = "<html><head><title>T &amp; x</title><script>no</script></head><body><h1>One</h1><p>a<p>b <b>c</b><div hidden>no</div><div style='display:none!important;display:block'>no</div><ul><li>i<li>j</ul><pre>k\n l</pre>rest</body>"
    title, b = html_blocks(page)
    assert title == "T & x"
    assert kinds(b) == [("Heading", "One"), ("Paragraph", "a"), ("Paragraph", "b c"), ("ListItem", "i"), ("ListItem", "j"), ("CodeFence", "k\n l"), ("Paragraph", "rest")]
    assert html_blocks("") == (None, []) and html_blocks("<h1>Only</h1>")[0] is None
    assert kinds(html_blocks("<dl><dt>t</dt><dd>d</dd></dl><table><caption>c</caption><tr><td>x</td></tr></table>")[1]) == [("Paragraph", x) for x in "tdcx"]


def test_chunks_are_slices_within_limits():
    words = " ".join(f"w{i}{'.' if i % 9 == 0 else ''}" for i in range(200))
    text, blocks = canonical(markdown_blocks(f"# A\n{words}\n\nshort\n\n## B\n- x\n- y\n\n```\n" + "\n\n".join(["line one\nline two"] * 20) + "\n```\n\n| h |\n|---|\n| 1 |\n| 2 |")[1])
    policy = ChunkPolicy(20, 24, 30, 5)
    chunks = chunk_blocks(text, blocks, policy)
    assert [c["seq"] for c in chunks] == list(range(len(chunks)))
    assert all(text.encode()[c["offset"] : c["offset"] + c["length"]].decode() == c["text"] and count_tokens(c["text"]) <= 30 for c in chunks)
    assert {"section", "code", "table"} <= {c["kind"] for c in chunks} and chunks[-3]["heading"] in ("A", "A > B")
    assert chunk_blocks("", [], policy) == []
    assert resolve_policy(" Code ") == ChunkPolicy(320, 420, 560, 24) and ChunkPolicy(0, 0, 0, 9).normalized() == ChunkPolicy(1, 1, 1, 0)
    assert generation_key("md", 2, policy).startswith("canonical:v1;chunker:v2;md:v2;target=20")


def test_extract_documents(spark):
    df = spark.createDataFrame([(1, "md", "# T\nx", 0), (2, "txt", None, 0), (3, "odd", "x", 0), (4, "code", "", 0)], "doc_id bigint, extractor_key string, text string, blocks int")
    assert {r.doc_id: (r.title, r.text) for r in extract_documents(df).collect()} == {1: ("T", "# T\n\nx"), 4: (None, "")}
    pdf = pdf_file("BT (One \\(1\\)) Tj T* [(two) -300 (th) 5 (ree)] TJ ET", "BT <66> Tj T* T* (last) Tj ET")
    df = spark.createDataFrame([(1, "pdf", None, pdf, "a.pdf"), (2, "pdf", None, b"%PDF-1.4 nothing", "b.pdf"), (3, "code", "x = 1", None, "a/b.PY"), (4, "pdf", "p\n\nq", None, "c.pdf")], "doc_id bigint, extractor_key string, text string, content binary, path string")
    out = {r.doc_id: r for r in extract_documents(df).collect()}
    assert out[1].text == "One (1)\ntwo three\n\nf\n\nlast" and out[2].text is None and "no text" in out[2].error
    assert out[3].blocks[0].attrs == {"language": "py"} and out[4].text == "p\n\nq"
    assert extractor_for("x/A.Kt") == "code" and extractor_for("x.sql") is None and extractor_for("y.PDF") == "pdf"


def pdf_file(*pages):
    out = b"%PDF-1.4\n"
    for k, page in enumerate(pages):
        body = page.encode("cp1252")
        head = b"<< /Length %d >>" % len(body)
        if k == 0:
            body = zlib.compress(body)
            head = b"<< /Length %d /Filter /FlateDecode >>" % len(body)
        out += b"%d 0 obj\n" % (k + 1) + head + b"\nstream\n" + body + b"\nendstream\nendobj\n"
    return out


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None)], "id bigint, text string")
    rows = token_windows(df, "id", "text", 10, 2).orderBy("window").collect()
    assert [(r.first_token, r.tokens) for r in rows] == [(0, 10), (8, 10), (16, 9)]


def test_byte_slices(spark):
    df = spark.createDataFrame([("aéb", 1, 2), ("aéb", 2, 1), ("aéb", 0, 9), (None, 0, 0)], "t string, o bigint, n bigint")
    assert [r[0] for r in df.select(T.byte_slice("t", "o", "n")).collect()] == ["é", None, None, None]


def test_walk_and_ignore(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", "node_modules/x/c.md", "Cargo.lock", "sub/keep.log", "sub/drop.log", "bin.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xfe" if name == "bin.md" else name.encode())
    found = files.list_files(spark, str(tmp_path), patterns="*.log\n# c\n!keep.log\n")
    assert {r.rel_path for r in found.collect()} == {"a.md", "sub/b.txt", "sub/keep.log", "bin.md"}
    assert {r.rel_path for r in files.list_files(spark, str(tmp_path), [" .MD "]).collect()} == {"a.md", "bin.md"}
    texts = {r.rel_path: r.text for r in files.read_files(found).collect()}
    assert texts["a.md"] == "a.md" and texts["bin.md"] is None
    assert files.count_ignore_patterns("a\n\n#b\n") == 1 and files.remove_ignore_pattern("a\nb\n", "a") == "b\n" and files.add_ignore_pattern("a\n", "a") == "a\n"
    assert files.disk_usage(spark, str(tmp_path)) > 0
    (tmp_path / "sub/.gitignore").write_text("*.txt\n/deep/\n")
    for name in ("sub/deep/n.md", "other/deep/n.md", "x.LOCK", "coverage/a.md", ".idea/k.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r.rel_path for r in files.walk_collection(spark, str(tmp_path), ["md", "txt", "lock"]).collect()} == {"a.md", "bin.md", "other/deep/n.md", ".idea/k.md"}
    paths = spark.createDataFrame([("a/b",), ("ab",), ("a",)], "p string")
    assert [r[0] for r in paths.select(files.under_failed_walk("p", ["a"])).collect()] == [True, False, True]


def test_beir_and_manifest(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"d1","title":"T","text":"x"}\n\n{"_id":"d2","title":"","text":"y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"a"}\n{"_id":"q2","text":"b"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t1\nq2\td1\t0\n")
    b = evalsets.import_beir(spark, str(tmp_path))
    assert b.judgments.count() == 2 and [r.query_id for r in b.cases.collect()] == ["q1"]
    assert {r.path: r.text for r in b.documents.collect()} == {"d1.md": "# T\n\nx\n", "d2.md": "y\n"}
    assert [j.path for j in evalsets.eval_cases(b.judgments).collect()[0].judgments] == ["d1.md", "d2.md"]
    (tmp_path / "qrels/test.tsv").write_text("q1\td9\t1\n")
    with pytest.raises(ValueError):
        evalsets.import_beir(spark, str(tmp_path))
    assert evalsets.load_manifest('[[cases]]\nquery = " a  b "\ncollections = ["c", "c"]\njudgments = [{path = "p", relevance = 1}]')[0]["query"] == "a b"
    with pytest.raises(ValueError):
        evalsets.load_manifest('[[cases]]\nquery = "a"\njudgments = [{path = "p", relevance = 0}]')


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("r", 1, 5), ("r", 2, 90), ("r", 3, 4), ("r", 4, 3), ("s", 1, 999)], "req string, o bigint, b bigint")
    assert {r.req: (r.taken, r.bytes) for r in budgeted_take(df, "req", "o", "b", 2, 10).collect()} == {"r": (2, 9), "s": (0, 0)}


def test_get(spark):
    docs = spark.createDataFrame([(1, "a/x.md", "abcdef0"), (2, "a/y.md", "abcdef1"), (3, "b/z.md", "123456f")], "doc_id bigint, path string, hash string")
    texts = spark.createDataFrame([(1, "l1\nl2\nl3"), (3, "q")], "doc_id bigint, text string")
    loc = spark.createDataFrame([("a/x.md",), ("#123456",), ("#abcdef",), ("a/none.md",)], "locator string")
    got = {r.locator: (r.matches, r.content) for r in get_documents(docs, texts, loc, 1, 1).collect()}
    assert got == {"a/x.md": (1, "l2"), "#123456": (1, ""), "#abcdef": (2, None), "a/none.md": (0, None)}
    assert [r[0] for r in texts.select(snippet("text", 2)).orderBy("doc_id").collect()] == ["l1\nl2\n(+1 more lines)", "q"]


def test_backlog_isolates_failures(spark):
    def embed(texts):
        if texts.str.contains("bad").any():
            raise ValueError("no")
        return texts.map(lambda t: [float(len(t))])

    rows = embed_backlog(spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(1, 8)], "chunk_id bigint, text string"), embed).collect()
    assert {r.chunk_id for r in rows if r.error} == {3} and all(r.embedding == [float(r.chunk_id)] for r in rows if not r.error)


def test_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    n = spark.createDataFrame([(2, None), (3, "c")], "k bigint, v string")
    assert sorted(map(tuple, C.upsert(t, n, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]
    r = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 8, 9), (2, 0, 0), (1, 2, 2)], "doc_id bigint, lo bigint, hi bigint")
    assert sorted(map(tuple, C.coalesced_seq_ranges(r).collect())) == [(1, 1, 5), (1, 8, 9), (2, 0, 0)]
    assert r.select(F.max(T.path_has_prefix(F.lit("a/b"), "a"))).first()[0] and T.normalize_prefix("./a//b/") == "a/b"
    with pytest.raises(ValueError):
        T.normalize_prefix("../a")
