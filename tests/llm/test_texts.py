"""Markup, code files, truncated texts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweir.llm import codefiles, markup, truncation

MARKED = {
    "a <b>bold</b> word": "a bold word", "see&nbsp;5": "see 5", "x &amp;lt;7&amp;gt; y": "x <7> y", "# Head\ntext": "Head\n\ntext", "**bold** and *it* and `code`": "bold and it and code",
    "[link](a/b.md) ![alt](i.png)": "link alt", "* one\n* two": "- one\n- two", "> quoted": "quoted", "| a | b |\n|---|---|\n| 1 | 2 |": "a  b\n1  2", "```py\nx = 1\n```": "    x = 1", "== Head ==\nt": "Head\n\nt",
    "[[page|label]] '''b''' {{t|x=1}}": "label b t, x=1", "[b]bold[/b]": "bold", "With $x^2$ and $$\\frac{a}{b}$$": "With x^2 and (a)/(b)", "\\begin{itemize}\n\\item a\n\\end{itemize}": "- a", "\\section{Top}\nx": "Top\n\nx",
    "broken <p clas": "broken", "rest\" class=\"x\">t": None, "Keep&nbsp19 pieces": None, "Head\n=====\nx": "Head\n\nx", "- [x] done": None, "<ul><li>a</li><li>b</li></ul>": "- a\n- b", "10\\% more": "10% more", "It was ~~no~~ yes": "It was no yes",
}
PLAIN = [
    "As long as a < 16 and b > 2, fine.", "Map<Page, List<Quota>> is deep; Vec<Compost> too.", "Press <Enter> now", "R&D; Q&A; x && y", "Files *.log and a_*.b", "2 ** 3 ** 2 = 64, 2 * 4 = 8", "Call me_now when __init__ fails", "It costs $ 4 or $ 98, set $HOME and $PATH",
    "|c| + |l| is small", "a|b|c is one", "The path is C:\\volume\\cache or \\\\share\\x", "A 6'' pipe and a 2'' hole", "reading [40] was [sic], f(x) [see] (or y)", "1. one\n2. two", "- one\n- two", "    <p>sample</p>\n    ## x", "C# <- x <3 -> y", "About ~32 of {1, 7}", "Ticket #53, a & b", "",
]


@pytest.mark.parametrize("text", list(MARKED))
def test_marked(text):
    assert markup.pieces(text)
    clean = markup.clean(text)
    assert not markup.pieces(clean), clean
    if MARKED[text] is not None:
        assert clean == MARKED[text]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert not markup.pieces(text)


EMPHASIS = ["_Note_: see below.", 'see "_the guide_" for more', "end:_now_, ok", "_a b_", "first\n_second_ line", "\u00a0_so it is_", "_¿qué?_ dijo", "so (_yes_)", "text\n_ _ _\nmore", 'rest" class\u00a0= "x">t']


def test_what_has_a_piece_is_suspect(spark):
    texts = [t for t in [*MARKED, *EMPHASIS] if markup.pieces(t)]
    assert set(EMPHASIS) <= set(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r.t for r in df.where(~F.col("t").rlike(markup.SUSPECT)).collect()] == []


TEXTS = "doc_id bigint, extractor_key string, text string, host string, paths string, kind string"
RESPONSES = "response_id bigint, content string, space_name string, collection_name string, text string, losing string"
ROWS = "row_id bigint, doc_id bigint, collection_id bigint, path string, recorded_at timestamp, home string, text string"


def test_clean_records_with_host_votes(spark):
    page = "<div class='nav{0}'><a href='/a'>home</a> <a href='/b'>about us all</a></div><p>Body {0} of the page with words.</p>"
    texts = spark.createDataFrame([(i, "html", page.format(i), "", "", "") for i in range(1, 4)] + [(1, "html", page.format(1), "", "", ""), (7, "code", "<b>x</b>", "", "", ""), (8, "md", None, "", "", ""), (9, "txt", "", "", "", ""), (10, None, "**x**", "", "", "")], TEXTS)
    responses = spark.createDataFrame([(1, "plain", "s", "c", "", ""), (2, "# h " + "x " * 200_000, None, None, "", ""), (None, "**x**", "s", "c", "", ""), (3, None, "s", "c", "", "")], RESPONSES)
    rows = spark.createDataFrame([(i, i, 5, "p", None, "", "") for i in range(1, 4)], ROWS)
    got = {(r.src_table, r.record_id): r.clean_text for r in markup.clean_records(texts, responses, rows).collect()}
    assert set(got) == {("document_texts", i) for i in (1, 2, 3, 10)} | {("document_responses", 2)}
    assert got["document_texts", 2] == "Body 2 of the page with words." and got["document_texts", 10] == "x"
    empty = [df.where("false") for df in (texts, responses, rows)]
    assert markup.clean_records(*empty).count() == 0
    assert len(markup.clean_records(texts, responses, empty[2]).collect()) == 5


def expand(rule_of, symbol):
    return sum((expand(rule_of, s) for s in rule_of[symbol]), []) if symbol in rule_of else [symbol]


def test_grammars_are_small_for_repeats():
    rng = np.random.default_rng(1)
    noise, loop, runs = rng.integers(0, 1 << 60, 256).astype("uint64"), np.tile(np.arange(8, dtype="uint64"), 32), np.zeros(256, "uint64")
    final, rules, found = codefiles.repair(np.concatenate([noise, loop, runs]), np.repeat([0, 1, 2], 256))
    assert final[0] == 256 and rules[0] == 0
    assert final[1] + 2 * rules[1] < 60 and final[2] + 2 * rules[2] < 60
    assert (found["uses"] >= 2).all() and found["tokens"].max() <= 256
    assert codefiles.repair(np.zeros(0, "uint64"), np.zeros(0, "int64"))[0].size == 0


HAND = "import os\nfrom .a import b\n\n# Loads the vendored tables at start-up.\ndef alpha(beta):\n    gamma = delta(beta, 7)\n    if gamma > 3:\n        raise ValueError('cold')\n    return [epsilon(x) for x in gamma if x != 9]\n\ndef zeta(eta):\n    with open(eta) as theta:\n        return theta.read(52)\n"
CODE = {
    1: (HAND, None), 2: ("// Code generated by x-gen v1. DO NOT EDIT.\n" + HAND, "generated"), 3: ("".join(f"def get_field_{i:03}(m):\n    return m.v[{i}]\n" for i in range(30)), "generated"),
    4: (";".join(f"function {c}(a,b){{return a?b.f{c}(3):a==b}}" for c in "abcdefghijklmnop"), "minified"), 5: ("const x = [\n" + ",\n".join("0x9d, 0xed, 0x1b, 0x31" for _ in range(40)) + "];", "data"),
    6: ("# DO NOT EDIT without asking the crew first.\n" + HAND, None), 7: ("# widgetry 1.2.3 - upstream copy, local changes go upstream\n" + HAND, "vendored"), 8: (HAND.replace("alpha", "omega"), "vendored"), 9: ("", None), 10: (HAND + "q = 'select a_b, c_d, " + "e_f, " * 60 + " from t'\n", None),
    11: ("# Not minified on purpose.\n" + HAND, None), 12: ("# Helpers for the code that the x generator emits; written and maintained by us.\n" + HAND, None),
}


def test_opaque_literals_of_one_case():
    rng = np.random.default_rng(3)
    for letters in ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for n in (64, 4000):
            literal = "".join(rng.choice(list(letters), n))
            assert codefiles.is_opaque(literal)
            assert codefiles.file_features([f"KEY = '{literal}'\n"])[0]["opaque_share"][0] > 0.5
    assert not any(map(codefiles.is_opaque, ["ab12" * 20, "0" * 60, "a1" * 30, "the_second_name_of_a_table_of_the_night_crew_2", "gettheveryverylongnameofthesecondtableofit2"]))
    assert codefiles.file_features([HAND])[0]["opaque_share"][0] == 0


def test_whole_comment_blocks_are_read():
    licence = "".join(f"// Line {i} of the terms.\n" for i in range(20))
    assert codefiles.header_says(licence + "// Code generated by x-gen v1. DO NOT EDIT.\n" + HAND) == (True, False)
    assert codefiles.header_says("/*\n" + "Some terms.\n" * 15 + "@license MIT\n*/\n" + HAND) == (False, True)
    assert codefiles.header_says(HAND + "# Code generated by x-gen.\n" + "# More.\n" * 9) == (True, False)
    assert codefiles.header_says(licence + HAND * 2 + "# code generated by x\n" + HAND) == (False, False)


def test_code_files(spark):
    texts = spark.createDataFrame([(i, "code", t, "", "", "") for i, (t, _) in CODE.items()] + [(1, "code", HAND, "", "", ""), (50, "code", None, "", "", ""), (51, "md", CODE[3][0], "", "", ""), (None, "code", CODE[3][0], "", "", "")], TEXTS)
    rows = spark.createDataFrame([(i, i, 1, "third_party/pkg/x.py" if i == 8 else "app/vendors/x.py" if i == 1 else "src/generated_totals.py", None, "", "") for i in CODE if i != 9] + [(99, 10, 1, None, None, "", "")], ROWS)
    got = {r.doc_id: r.kind for r in codefiles.classify_code(texts, rows).collect()}
    assert got == {i: kind for i, (_, kind) in CODE.items()}
    assert codefiles.classify_code(texts.where("false"), rows).count() == 0
    assert {r.doc_id: r.kind for r in codefiles.classify_code(texts, rows.where("false")).collect()}[8] is None


DOCS = "doc_id bigint, text string, source string, announced_chars bigint, n int, tail string, cut string"


def test_truncated_texts(spark):
    names = "harbor lantern meadow silo gateway ladder compass trellis orchard beehive".split()
    verbs = "covers guards mirrors restores splits".split()
    full = lambda i: f"The {names[i % 10]} {verbs[i % 5]} the {names[(i * 7 + 3) % 10]} before the evening run. Because the {names[(i + 4) % 10]} was missing, nobody noticed it."
    docs = [(i, full(i) + " " + full(i + 3), "src", None) for i in range(120)]
    cut = {
        200: full(1) + " The lantern guards the orch", 201: full(2) + " Nobody noticed that the", 202: full(3) + " [truncated]", 203: full(4)[:-1] + "�", 204: "int f(int a) {\n    if (a > 3) {\n        return a;", 205: full(5) + " The gateway mirrors the compass before the evening",
        206: full(6) + "\n[output cut, 12 bytes omitted]", 207: full(7) + " Because the meadow w...",
    }
    whole = {300: full(1) + "\n\n- one silo\n- two ladder", 301: full(2) + "\n\nBest wishes\nthe night crew", 302: "the harbor covers the silo before the evening run", 303: full(3) + " and so on…", 304: "int f(int a) {\n    return a;\n}\n", 305: "n/a", 306: full(5) + " The part marked [truncated] is on the back."}
    rows = docs + [(k, t, "src", None) for k, t in {**cut, **whole}.items()]
    rows += [(400, full(8) + " See harbor", "src", 900), (401, "Grüße. " + full(9), "src", len(("Grüße. " + full(9)).encode())), (402, None, "src", 5), (403, "", None, None), (404, "x" * 100_000, None, None), (200, cut[200], "src", None), (None, cut[200], "src", None)]
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], DOCS)
    e = truncation.truncation_evidence(df)
    got = {r.doc_id for r in e.where("cut").collect()}
    assert got == {*cut, 400}
    by = {r.source: (r.texts, r.cut) for r in truncation.truncation_by_source(e).collect()}
    assert by["src"] == (120 + len(cut) + len(whole) + 2, len(cut) + 1)
    assert truncation.truncation_evidence(df.where("false")).count() == 0


def test_field_limits(spark):
    base = "The harbor covers the silo and the ladder before the evening run. "
    rows = [(i, (base * 9)[: 300 if i < 12 else 66 * (i % 8 + 1)], "form", None, 0, "", "") for i in range(60)]
    found = {r.doc_id: r.reason for r in truncation.truncation_evidence(spark.createDataFrame(rows, DOCS)).where("cut").collect()}
    assert set(found) == set(range(12))


def test_short_field_limits(spark):
    base = "the harbor covers the silo and the ladder before the evening run and the meadow"
    whole = lambda i: f"{i} lanterns " + base[: 20 + i % 50].rsplit(" ", 1)[0]
    rows = [(i, whole(i), "form", None) for i in range(60)] + [(100 + i, (f"{i:02} lanterns {base} {base}")[: 13 + len(base) + len("the harbor covers the silo")], "form", None) for i in range(12)]
    rows += [(200 + i, f"{i:02} lanterns of the harbor", "log", None) for i in range(20)] + [(300, "the longest of all the lines and no case", "log", None)]
    rows += [(400 + i, base + " tonight", "copies", None) for i in range(20)] + [(500 + i, whole(i), "copies", None) for i in range(40)]
    e = truncation.truncation_evidence(spark.createDataFrame([(*r, 0, "", "") for r in rows], DOCS))
    assert {r.doc_id for r in e.where("at_limit").collect()} == {r.doc_id for r in e.where("reason = 'field limit'").collect()} == set(range(100, 112))


def test_cut_words_do_not_depend_on_the_size(spark):
    rows = [(i, f"The review of batch {i} covers the retry, the replay and the report before the relay. Some release follows.", "src") for i in range(120)]
    rows += [(k, "The crew must re-index the relay after the replay.", "src") for k in (200, 201)]
    rows += [(300, "nobody saw the second re", "src"), (301, "nobody saw the second review", "src"), (302, "nobody saw the second rep...", "src"), (303, "someone asked for a relay", "src")]
    found = []
    for times in (1, 10):
        more = [(k + 1000 * j, t, s, None, 0, "", "") for k, t, s in rows for j in range(times)]
        found.append({r.doc_id for r in truncation.truncation_evidence(spark.createDataFrame(more, DOCS)).where("reason = 'word'").collect()})
    assert found[0] == {300, 302}
    assert found[1] == {k + 1000 * j for k in found[0] for j in range(10)}


def test_words_and_endings():
    assert truncation.words("fooBar_baz Straße ABC") == ["foo", "bar", "baz", "straße", "abc"]
    statistics = truncation.Statistics()
    statistics.add("One two. Three fo")
    counts = Counter(statistics.rows())
    assert truncation.sentences("A b.  C!\n\n (d?) e") == ["A b.", "C!", "(d?", "e"]
    assert counts["w", "fo", 0] == counts["w", "fo", 1] == 0 and counts["f", "fo", 1] == 1 and counts["w", "two", 1] == 1
    assert truncation.ending(None)["stopped"] and truncation.ending("a b (continued)")["mark"] is False and truncation.ending("a b... (continued)")["mark"]
