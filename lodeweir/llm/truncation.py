"""Texts cut off by field limits or in transfer (problem 10): a vocabulary trie and length evidence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweir.session import broadcast_if_small, materialize

_WORD = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿœ]+|[^\W\d_a-zß-öø-ÿœ]+(?![a-zß-öø-ÿœ])|[^\W\d_]+")
_TAIL = re.compile(r"[^\W\d_]+\Z")
_END = re.compile(r"[.!?。！？][\"'”’»)\]]*\s+|\n+")
_STOPS, _CLOSERS, _CLOSED = frozenset(".!?。！？"), "\"'”’»)]}", frozenset("]})>\"'”’»|:`~*_=")
_SMILE, _TICKS = re.compile(r"[:;]-?[)(DP]\Z"), re.compile(r"^\s*```", re.MULTILINE)
_LETTER, _AT_END = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]\W*\Z")
_STARTER = re.compile(r"^\W*(\w+)\W+(\w+)")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])\s")
_STAMP = re.compile(r"^(?:\d{4}-\d\d-\d\d[T ][\d:.,]+\s+(?:[A-Z]+\s+)?\S+:\s*|[QA]:\s*|Note:\s*)")
#: Marks that say that the rest was left out, at the very end of a text.
_MARK = re.compile(
    r"(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|\[(?:truncated|cut|snip|continued|more)\]|<(?:snip|cut|truncated|more)>|\[output cut[^\]\n]*\]|\[[^\]\n]*\b(?:omitted|truncated)\]|\(\+\s?\d+ more [^)\n]*\)"
    r"|(?:\.\.\.|…)\s*\(?(?:continued|cont\.?|more|read more|show more)\)?|(?<=[.!?…\w])\s+(?:Read|Show) more(?:\.\.\.|…)?)\s*$",
    re.IGNORECASE,
)
_ELLIPSIS = re.compile(r"\s?(?:\.\.\.|…)\s*$")
_CODE_LINE = re.compile(
    r"[{};]\s*$|^\s*(?:def \w|class \w+[(:]|(?:if|for|while|elif|else)\b[^\n]*[:{(;]\s*$|return\b|import [\w.{*\"']+|from [\w.]+ import|(?:fn|func|function) \w+\(|local \w+=|#include|use \w+::|export |static \w|log\()|^\s+\w+ [-+*]?= ",
    re.MULTILINE,
)
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include))")
#: Least share of sentences with a full stop that makes a kind of sentence, or an author, one that sets them.
SETS_STOPS = 0.7
#: A word that ends a sentence or line less often than this ends no text; so many endings are counted beside those seen, so
#: that a rate from few occurrences proves nothing.
ENDS_SHARE, ENDS_PRIOR = 0.004, 0.16
#: A token that occurs by itself at most this often for each occurrence of the words it begins is no word but a piece of one.
FRAGMENT_SHARE = 1 / 200
#: Shorter texts are entries like "n/a", of which a last word proves nothing.
LEAST_CHARS = 12
#: A length is a field limit of a source where so many of its texts, and this share, have it.
LIMIT_COUNT, LIMIT_SHARE = 5, 0.01
#: Below this length many texts may be equally long by chance, so that a limit must besides be the greatest length of its
#: source, have LIMIT_COUNT different texts and so many times the texts of the lengths that are up to a tenth shorter.
CHANCE_LENGTH, LIMIT_PEAK = 200, 5


def words(text: str) -> list[str]:
    """Lower-cased words; camel case and underscores separate."""
    return [w.lower() for w in _WORD.findall(text)]


def stops(t: str) -> bool:
    """Whether a text ends with a full stop, behind which quotes and brackets may stand."""
    return t.rstrip(_CLOSERS)[-1:] in _STOPS


def sentences(t: str) -> list[str]:
    """Pieces between line ends and full stops with white space behind them; blank ones are left out."""
    out, at = [], 0
    for m in _END.finditer(t):
        stop = m.start() + (t[m.start()] != "\n")
        if t[at:stop].strip():
            out.append(t[at:stop])
        at = m.end()
    if t[at:].strip():
        out.append(t[at:])
    return out


class Statistics:
    """Counts of (kind, key, ends): words (w), unstopped last words (f) and beginnings of finished sentences (s).

    White-space tokens, last tokens and beginnings are counted as they stand; only distinct ones are looked into.
    """

    def __init__(self):
        self.tokens, self.last, self.begin, self.final, self.slow = Counter(), Counter(), Counter(), Counter(), Counter()

    def __len__(self) -> int:
        return len(self.tokens) + len(self.last) + len(self.begin)

    def add(self, text: str) -> None:
        """A text's words, except an unstopped last one, and its finished sentences."""
        self.tokens.update(text.split())
        pieces = sentences(text.rstrip())
        tails = [p.rstrip() for p in pieces]
        stopped = [stops(t) for t in tails]
        self.last.update([t.rsplit(None, 1)[-1] for t in (tails if not tails or stopped[-1] else tails[:-1])])
        for k, (piece, stop) in enumerate(zip(pieces, stopped, strict=True)):
            if k == len(pieces) - 1 and not stop:
                self._unfinished(tails[k])
            elif not _ITEM.match(piece):
                head = piece[_STAMP.match(piece).end() :] if _STAMP.match(piece) else piece
                start = _STARTER.match(head)
                if start:
                    self.begin[start[1], start[2], stop] += 1

    def _unfinished(self, tail: str) -> None:
        found = words(tail)
        if found:
            self.slow["w", found[-1], 0] -= 1
            if _LETTER.match(tail[-1]):
                self.final[found[-1]] += 1

    def rows(self) -> Counter:
        """The counts, with negative corrections of words."""
        out: Counter = Counter(self.slow)
        for token, n in self.tokens.items():
            for w in words(token):
                out["w", w, 0] += n
        for token, n in self.last.items():
            found = words(token)
            if found and _AT_END.search(token):
                out["w", found[-1], 1] += n
                out["w", found[-1], 0] -= n
        for (x, y, stop), n in self.begin.items():
            out["s", f"{_plain(x)} {_plain(y)}", int(stop)] += n
        for w, n in self.final.items():
            out["f", w, 1] += n
        return out


def _plain(w: str) -> str:
    return "0" if w[0].isdigit() else w


def _has_mark(t: str) -> bool:
    """Whether a text without trailing white space ends in a mark; marks reach over two lines with text at most."""
    if t[-1] not in "])>…." and not t[-9:].lower().endswith(("more", "cont", "continued")):
        return False
    lines = t.split("\n")
    k, seen = len(lines), 0
    while k and seen < 2:
        k -= 1
        seen += bool(lines[k].strip())
    return bool(_MARK.search("\n".join(lines[k:])))


def ending(text: str | None) -> dict:
    """What the end of a text shows by itself; of texts that end with a stop no more than that is asked."""
    out = {"mark": False, "broken": False, "ellipsis": False, "stopped": True, "tail": None, "last": None, "item": False, "starter": None, "author": -1.0, "inline": False, "brief": False, "code": False, "in_number": False, "open_code": False}
    if not text or not text.strip():
        return out
    t = text.rstrip()
    out["broken"] = t.endswith("\ufffd")
    out["mark"] = _has_mark(t)
    if t.endswith(("...", "…")) and not out["mark"]:
        out["ellipsis"] = True
        t = _ELLIPSIS.sub("", t[-8:]) if len(t) < 9 else t[:-8] + _ELLIPSIS.sub("", t[-8:])
    out["stopped"] = stops(t) or t[-1:] in _CLOSED or bool(_SMILE.search(t[-3:]))
    out["in_number"] = t[-1:] == "." and t[-2:-1].isdigit()
    out["open_code"] = ("```" in t and len(_TICKS.findall(t)) % 2 == 1) or (t.count("{") > t.count("}") and len(_CODE_LINE.findall(t)) >= 2)
    if out["stopped"] and not out["ellipsis"]:
        return out
    tail = _TAIL.search(t[t.rfind("\n") + 1 :])
    if tail and not text[len(t) :].count("\n"):
        found = words(tail[0])
        out["tail"] = found[-1] if found else None
    lines = t.split("\n")
    line = lines[-1]
    if line and _LETTER.match(line[-1]):
        found = words(line)
        out["last"] = found[-1] if found else None
    out["item"] = bool(_ITEM.match(line))
    above = lines[-2].split() if len(lines) > 1 else []
    out["brief"] = len(line.split()) <= 3 and not re.search(r"\d", line) and 0 < len(above) <= 3
    pieces = sentences(_COMMENT_LINE.sub("", line[_STAMP.match(line).end() :] if _STAMP.match(line) else line).lstrip())
    out["inline"] = len(pieces) > 1
    if pieces:
        start = _STARTER.match(pieces[-1])
        out["starter"] = f"{_plain(start[1])} {_plain(start[2])}" if start else None
    prose = [p for p in sentences(t)[:-1] if not _ITEM.match(p) and len(p.split()) >= 5 and not _CODE_LINE.search(p.rstrip())]
    if prose:
        out["author"] = sum(stops(p.rstrip()) for p in prose) / len(prose)
    out["code"] = bool(_CODE_LINE.search("\n".join(lines[-3:]))) and not _COMMENT_LINE.match(line) and len(_CODE_LINE.findall(t)) >= 2
    return out


_EVIDENCE = "n bigint, b bigint, h bigint, announced bigint, mark boolean, broken boolean, ellipsis boolean, stopped boolean, tail string, last string, item boolean, starter string, author double, inline boolean, brief boolean, code boolean, in_number boolean, open_code boolean"
_SCANNED = f"part string, kind string, key string, ends int, k bigint, doc_id bigint, source string, {_EVIDENCE}"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts: rows of statistics (part w) and of endings (part e)."""
    counts = Statistics()

    columns = dict(c.split() for c in _SCANNED.split(", "))

    def frame(found: dict, n: int) -> pd.DataFrame:
        """All columns, plain objects, null where there is nothing."""
        return pd.DataFrame({c: pd.Series(found[c] if c in found else [None] * n, dtype=object) for c in columns})

    def flush() -> pd.DataFrame:
        rows = [("w", k, w, e, n) for (k, w, e), n in counts.rows().items() if n]
        return frame(dict(zip(("part", "kind", "key", "ends", "k"), zip(*rows, strict=True), strict=True)) if rows else {}, len(rows))

    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            counts.add(text)
            rows.append(ending(text))
        own = {c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns if c != "text"}
        yield frame({"part": ["e"] * len(pdf), **own, **{c: [r[c] for r in rows] for c in ending("")}}, len(pdf))
        if len(counts) > 400_000:
            yield flush()
            counts = Statistics()
    yield flush()


def truncation_evidence(documents: DataFrame) -> DataFrame:
    """One row per document with text: its ending, what the corpus says of it, and ``cut`` with a ``reason``.

    The vocabulary is counted over all texts without their last words, and its trie is kept as a table of its nodes
    (prefix, words below). A text is cut where it ends

    - in a broken character, at a mark that says that the rest was left out, or in an open code block;
    - in a token that is no word but a proper prefix of words (before an ellipsis too): next to these words it hardly
      occurs by itself, as a share, so that neither the size of the corpus nor copies of its texts decide;
    - without a stop in a word that hardly ever ends a sentence or line;
    - without a stop in a kind of sentence that has one, of an author who sets them, or behind another sentence of the
      same line;
    - without a stop at a length that many texts of its source have (a short one: its greatest, and it stands out), or short of the announced characters (a
      number that equals the bytes is no shortage).

    Null and empty texts, texts that only lack a stop because their author sets none, items, footers, signatures
    and deliberate ellipses are no cases; a null source has no field limits. Repeats of a doc_id count once.
    """
    base = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "source", F.length("text").cast("bigint").alias("n"), F.octet_length("text").cast("bigint").alias("b"), F.xxhash64("text").alias("h"), F.col("announced_chars").cast("bigint").alias("announced"), "text")
    scanned = materialize(base.mapInPandas(_scan, _SCANNED), "scan", partition_by=["part"])
    stats = scanned.where("part = 'w'").groupBy("kind", "key").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("ends")).alias("at_end"))
    stats = materialize(stats.where("n > 0"), "words")
    ends = scanned.where("part = 'e'").drop("part", "kind", "key", "ends", "k").dropDuplicates(["doc_id"])
    vocabulary = stats.where("kind = 'w'")
    nodes = vocabulary.where("n >= 2 and length(key) > 1").select(F.explode(F.expr("transform(sequence(1, length(key) - 1), i -> substring(key, 1, i))")).alias("tail"), "n").groupBy("tail").agg(F.sum("n").alias("below"))
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in "nb"])
    lengths = ends.where("source is not null").select("source", "h", F.explode(units).alias("x")).groupBy("source", "x.unit", "x.size").agg(F.count("*").alias("k"), F.count_distinct(F.when(F.col("x.size") < CHANCE_LENGTH, F.col("h"))).alias("texts"))
    totals = ends.groupBy("source").agg(F.count("*").alias("total"))
    frequent = lengths.where(F.col("k") >= LIMIT_COUNT).join(totals, "source").where(F.col("k") >= LIMIT_SHARE * F.col("total"))
    greatest = lengths.groupBy("source", "unit").agg(F.max("size").alias("most")).where(F.col("most") < CHANCE_LENGTH)
    near = lengths.join(greatest, ["source", "unit"]).where((F.col("size") < F.col("most")) & (F.col("size") >= 0.9 * F.col("most"))).groupBy("source", "unit").agg(F.sum("k").alias("near"))
    peak = (F.col("texts") >= LIMIT_COUNT) & (F.col("k") * F.greatest(F.floor(F.col("size") / 10), F.lit(1)) >= LIMIT_PEAK * F.coalesce("near", F.lit(0)))
    short = frequent.where(F.col("size") < CHANCE_LENGTH).join(greatest.withColumnRenamed("most", "size"), ["source", "unit", "size"]).join(near, ["source", "unit"], "left").where(peak)
    limits = frequent.where(F.col("size") >= CHANCE_LENGTH).select("source", "unit", "size").unionByName(short.select("source", "unit", "size"))
    limits = materialize(limits.select("source", "unit", "size"), "limits")
    few = broadcast_if_small(limits, 100_000)
    chars, octets = few.where("unit = 'n'").select("source", F.col("size").alias("n"), F.lit(True).alias("at_chars")), few.where("unit = 'b'").select("source", F.col("size").alias("b"), F.lit(True).alias("at_bytes"))
    known = vocabulary.select(F.col("key").alias("tail"), F.col("n").alias("tail_n"))
    final = vocabulary.select(F.col("key").alias("last"), F.col("n").alias("last_n"), F.col("at_end").alias("last_end"))
    closing = stats.where("kind = 'f'").select(F.col("key").alias("last"), F.col("n").alias("last_final"))
    begin = stats.where("kind = 's'").select(F.col("key").alias("starter"), F.col("n").alias("start_n"), F.col("at_end").alias("start_stop"))
    df = ends.join(chars, ["source", "n"], "left").join(octets, ["source", "b"], "left")
    # only texts without a stop ask for words, each distinct word once; a word that ends a third of them is a hot key of
    # a left join, which adaptive skew handling splits
    open_ends = F.coalesce(~F.col("stopped") | F.col("ellipsis"), F.lit(False))
    asking = materialize(df.where(open_ends), "open")
    for key, facts in (("tail", (known, nodes)), ("last", (final, closing)), ("starter", (begin,))):
        asked = asking.where(F.col(key).isNotNull()).select(key).distinct()
        for fact in facts:
            asked = asked.join(fact, key, "left")
        asking = asking.join(broadcast_if_small(asked, 200_000), key, "left")
    df = asking.unionByName(df.where(~open_ends), allowMissingColumns=True)
    df = df.withColumn("at_limit", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))
    df = df.withColumn("short", F.coalesce((F.col("announced") > F.col("n")) & (F.col("announced") > F.col("b")), F.lit(False)))
    unknown = (F.coalesce("tail_n", F.lit(0)) <= FRAGMENT_SHARE * F.col("below")) & (F.col("below") > 0)
    never = (F.col("last_end") + F.coalesce("last_final", F.lit(0)) + ENDS_PRIOR < ENDS_SHARE * (F.col("last_n") + ENDS_PRIOR)) & (F.col("n") >= LEAST_CHARS)
    prose = (F.col("start_n") >= 5) & (F.col("start_stop") >= SETS_STOPS * F.col("start_n"))
    loose = ~F.col("stopped") & ~F.col("ellipsis")
    reason = (
        F.when(F.col("mark"), "mark")
        .when(F.col("broken"), "character")
        .when(F.col("open_code"), "code block")
        .when((loose | F.col("ellipsis")) & unknown, "word")
        .when(loose & never, "clause")
        .when(loose & ~F.col("item") & ~F.col("code") & (F.col("author") >= SETS_STOPS) & (F.col("inline") | prose), "clause")
        .when(loose & F.col("at_limit") & ~F.col("item") & ~F.col("code") & ~F.col("brief"), "field limit")
        .when((loose | F.col("ellipsis") | F.col("in_number")) & F.col("short"), "announced length")
    )
    return df.select("doc_id", "source", reason.alias("reason"), "at_limit", "short", "tail", "last", "author").withColumn("cut", F.col("reason").isNotNull())


def truncation_by_source(evidence: DataFrame) -> DataFrame:
    """(source, texts, cut, share, field_limit): how often each source truncates."""
    return evidence.groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share"), F.count_if(F.col("cut") & F.col("at_limit")).alias("at_field_limit")
    )
