"""Splitting at natural boundaries."""

import random

import pytest

from lodeweir.llm.split import count_tokens, split_oversized

CHUNKS = "chunk_id bigint, doc_id bigint, seq int, byte_offset bigint, heading string, kind string, extractor_key string, text string, cost double, piece int, rank int"
POLICIES = "extractor_key string, target_tokens int, soft_max_tokens int, hard_max_tokens int, overlap_tokens int, hard_max_bytes int, text string"


def chunk(i, text, key="md", offset=100):
    return (i, i, 0, offset, "H", "section", key, text, 0.0, 1, 2)


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdéö") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", "", ".", ",", "!\n", ".\n\n"]) for _ in range(n))
    return {
        1: prose(10), 2: prose(500), 3: prose(3000), 4: "x" * 5000, 5: "、".join(["文字列" * 9 + "。"] * 60), 6: "", 7: None, 8: "  \n " * 300, 9: prose(30) + " " * 900 + prose(60), 10: "a　b c " * 200,
        11: "\n\n".join("line " * 8 for _ in range(90)), 12: ("word " * 24 + "end. ") * 30,
    }


@pytest.mark.parametrize("segment", [1 << 16, 333])
def test_pieces(spark, segment):
    source = texts()
    rows = [chunk(i, t) for i, t in source.items()] + [chunk(2, source[2]), chunk(20, source[2], "none"), chunk(21, source[2], None), chunk(None, source[2]), chunk(22, source[2], "md", None)]
    policies = spark.createDataFrame([("md", 20, 24, 30, 4, 260, "p"), ("md", 20, 24, 30, 4, 260, "p"), (None, 1, 1, 1, 0, 9, "p")], POLICIES)
    out = split_oversized(spark.createDataFrame(rows, CHUNKS), policies, segment, segment).toPandas()
    wide = split_oversized(spark.createDataFrame(rows, CHUNKS), policies, 5 * segment, segment).toPandas()
    key = lambda d: sorted(zip(d.chunk_id, d.piece, d.chunk_offset, d.text, strict=True))
    assert key(out) == key(wide)  # the size of ranges changes no piece
    over = {i for i, t in {**source, 22: source[2]}.items() if t and (count_tokens(t) > 30 or len(t.encode()) > 260)}
    assert set(out["chunk_id"]) == over
    for i, g in out.groupby("chunk_id"):
        raw, at, g = source.get(i, source[2]).encode(), 0, g.sort_values("piece")
        assert list(g["piece"]) == list(range(len(g)))
        for p in g.itertuples():
            assert raw[p.chunk_offset : p.chunk_offset + p.byte_length].decode() == p.text and p.heading == "H"
            assert p.byte_length <= 260 and count_tokens(p.text) <= 30 and p.tokens == count_tokens(p.text)
            assert p.chunk_offset <= at
            at = p.chunk_offset + p.byte_length
        assert at == len(raw)
    assert out[out.chunk_id == 22]["byte_offset"].isna().all() and (out[out.chunk_id == 2].eval("byte_offset - chunk_offset") == 100).all()
    same = out[(out.chunk_id == 12) & (out.piece > 0)]
    ends = out[out.chunk_id == 12].sort_values("piece")
    natural = (ends["ends_at"][:-1] == "sentence").mean()
    assert natural == 1 if segment > 1000 else natural > 0.9  # segments of a few sentences have ends of their own
    assert len(same)
    starts, stops = ends["chunk_offset"].tolist()[1:], (ends["chunk_offset"] + ends["byte_length"]).tolist()[:-1]
    assert {count_tokens(source[12].encode()[a:b].decode()) for a, b in zip(starts, stops, strict=True)} <= ({4} if segment > 1000 else {0, 4})


def test_empty_tables(spark):
    e = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], POLICIES)
    assert split_oversized(*e).count() == 0
    assert split_oversized(spark.createDataFrame([chunk(1, "a " * 99)], CHUNKS), e[1]).count() == 0
