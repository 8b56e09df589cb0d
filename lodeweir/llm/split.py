"""Splitting oversized texts at natural boundaries (problem 2), by byte ranges.

A text is cut into byte ranges; workers see a range with a halo on either side and never the whole text. Atoms
(tokens, further cut after ideographic full stops and at fixed byte offsets, as is white space, so that giant runs need no look-ahead)
are the same from whatever range they are seen. Segments lie on a fixed grid: each runs from the first natural boundary behind
its grid point to the first one behind the next, which its neighbour finds as its beginning too: so the boundary tables stitch without
gaps, each segment is cut alone, and the pieces of one giant text are made in parallel. A range holds any number of
whole segments, so its size decides how work is split and never what the pieces are. Prefix sums over the ranges count
tokens and number the pieces; texts are emitted by offset from the range that ends them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweir.session import materialize

#: Bytes between the grid points of segments, which the pieces depend on, and of a range without halos, which they do not.
SEGMENT_BYTES, RANGE_BYTES = 1 << 16, 1 << 18
#: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
_TOKEN = re.compile(f"[^{SPACE}]+")
_BOUNDARY = re.compile(f"[^{SPACE}]+?(?:[。！？]+[」』”）]*|(?=[{SPACE}])|$)")
_SENTENCE = re.compile(r"[.!?…。！？]['\")\]}»”’」』）]*$")
_CLAUSE = re.compile(r"[,;:，；：、]['\")\]}»”’]*$")
_BLOCK = re.compile(r"\n[^\S\n]*\r?\n| ")
_LINE = re.compile(r"[\n\r \x85]")
#: Rank of what ends an atom; natural boundaries are those of at least NATURAL.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, BLOCK = 0, 1, 2, 4, 5, 6
NATURAL = SENTENCE
NAMES = {INSIDE: "inside a token", WORD: "word", CLAUSE: "clause", SENTENCE: "sentence", LINE: "line", BLOCK: "block"}


def count_tokens(text: str) -> int:
    """Number of maximal runs of characters other than White_Space."""
    return len(_TOKEN.findall(text))


def atom_table(raw: bytes, base: int, begin: int, end: int, atom_bytes: int) -> pd.DataFrame:
    """Atoms of the slice ``raw`` (absolute offset ``base``) that begin before ``end``: start, stop, rank, token.

    Offsets are absolute bytes; ``token`` is true where the atom begins a token, ``rank`` tells what ends it.
    """
    lead = 0
    while base > 0 and lead < len(raw) and raw[lead] & 0xC0 == 0x80:
        lead += 1
    text = raw[lead:].decode("utf-8", "ignore")
    at = np.frombuffer(raw, np.uint8)[lead:]
    places = np.append(np.flatnonzero((at & 0xC0) != 0x80), len(at)) + base + lead
    starts, stops, ranks, tokens = [], [], [], []

    def white(a: int, b: int) -> None:
        """Atoms of a run of white space [a, b): one from each fixed offset on; what comes before belongs to the token."""
        at = [a] if a == 0 and base == 0 and b else []
        at += [j for m in range(int(places[a]) // atom_bytes + 1, int(places[b] - 1) // atom_bytes + 1) if (j := int(np.searchsorted(places, m * atom_bytes))) < b]
        for j, k in zip(at, [*at[1:], b][: len(at)], strict=True):
            starts.append(places[j])
            stops.append(places[k])
            tokens.append(False)
            ranks.append(LINE if _LINE.search(text[j:k]) else WORD)

    end_of_last = 0
    for token in _TOKEN.finditer(text):
        fresh = True
        white(end_of_last, token.start())
        end_of_last = token.end()
        for part in _BOUNDARY.finditer(text, token.start(), token.end()):
            a, b = part.span()
            cut = (places[a] // atom_bytes + 1) * atom_bytes
            while a < b:
                stop = b
                if places[b] > cut:
                    stop = max(a + 1, int(np.searchsorted(places, cut, "right")) - 1)
                    cut += atom_bytes
                starts.append(places[a])
                stops.append(places[stop])
                tokens.append(fresh)
                fresh = False
                if stop < token.end():
                    ranks.append(SENTENCE if stop == b and _SENTENCE.search(text[a:stop]) else INSIDE)
                else:
                    gap_end = token.end()
                    while gap_end < len(text) and gap_end < token.end() + 256 and not _TOKEN.match(text[gap_end]):
                        gap_end += 1
                    gap = text[token.end() : gap_end]
                    word = text[max(token.start(), token.end() - 24) : token.end()]
                    ranks.append(BLOCK if _BLOCK.search(gap) else LINE if _LINE.search(gap) else SENTENCE if _SENTENCE.search(word) else CLAUSE if _CLAUSE.search(word) else WORD)
                a = stop
    white(end_of_last, len(text))
    out = pd.DataFrame({"start": np.array(starts, "int64"), "stop": np.array(stops, "int64"), "rank": np.array(ranks, "int64"), "token": np.array(tokens, bool)})
    if base > 0 and len(out) and begin > base:
        out = out.iloc[1:]  # its beginning may lie before the slice
    return out[out["start"] < end].reset_index(drop=True)


def _atom_bytes(hard_bytes: int) -> int:
    return max(16, hard_bytes // 16)


def _token_starts(raw: bytes, base: int, begin: int, end: int) -> int:
    """Tokens that begin in [begin, end) of a slice that starts at ``base``."""
    left, right = begin - base, end - base
    while 0 < left < len(raw) and raw[left] & 0xC0 == 0x80:
        left += 1
    while right < len(raw) and raw[right] & 0xC0 == 0x80:
        right += 1
    own = raw[left:right].decode("utf-8", "ignore")
    before = raw[max(0, left - 4) : left].decode("utf-8", "ignore")[-1:]
    return count_tokens(own) - bool(before and own and _TOKEN.match(before) and _TOKEN.match(own))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r.chunk_id, r.range_no, _token_starts(bytes(r.raw), r.base, r.begin, r.end)) for r in pdf.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["chunk_id", "range_no", "tokens"])


def _anchor(t: pd.DataFrame, at: int, within: int) -> int:
    """First atom that begins at or after ``at``, behind a natural boundary if there is one within so many bytes."""
    start, rank = t["start"].to_numpy(), t["rank"].to_numpy()
    first = int(np.searchsorted(start, at))
    for k in range(first, len(t)):
        if start[k] > at + within:
            break
        if k and rank[k - 1] >= NATURAL:
            return k
    return first


def cut_segment(t: pd.DataFrame, first: int, last: int, begin: int, end: int, target: int, hard_tokens: int, overlap: int, hard_bytes: int) -> list[tuple[int, int, int]]:
    """(start, stop, rank) of the pieces of atoms [first, last), which fill bytes [begin, end); see split_oversized."""
    start, stop, rank, token = (t[c].to_numpy() for c in ("start", "stop", "rank", "token"))
    seen = np.append(0, np.cumsum(token))
    out, at, begin_at = [], first, begin  # the next new atom; where the piece starts
    lead = first
    overlap = min(overlap, hard_tokens - 1)

    def step_back(k: int) -> int:
        """Atom at which the overlap before atom k starts: so many tokens back, as long as one more token fits behind them."""
        ahead = k + 1
        while ahead < last and not token[ahead]:
            ahead += 1
        new = min(int(stop[ahead - 1] - stop[k - 1]), hard_bytes // 2) if k < last else 0
        got, j = 0, k
        for i in range(k - 1, -1, -1):
            if got == overlap or stop[k - 1] - start[i] + new > hard_bytes:
                break
            if token[i]:
                got, j = got + 1, i
        if got == 0 and overlap:  # inside a giant token, as in scripts without spaces: atoms of as many bytes as tokens of full pieces
            while j and j - 1 >= 0 and stop[k - 1] - start[j - 1] <= min(overlap * hard_bytes // hard_tokens, hard_bytes - new):
                j -= 1
        return j

    if first and begin:
        lead = step_back(first)
        begin_at = int(start[lead]) if lead < first else begin
    while at < last:
        inside = 0 if token[lead] or lead == 0 or rank[lead - 1] != INSIDE else 1
        fits = int(np.searchsorted(stop[at:last], begin_at + hard_bytes, "right")) + at
        fits = min(fits, int(np.searchsorted(seen[at + 1 : last + 1], seen[lead] + hard_tokens - inside, "right")) + at)
        fits = max(fits, at + 1)
        if fits >= last:
            out.append((begin_at, end, int(rank[last - 1])))
            break
        k = np.arange(at, fits)
        r = rank[k]
        kind = np.where(r >= NATURAL, 3.0 + 0.02 * r, r)
        along = np.maximum((seen[k + 1] - seen[lead]) / target, (stop[k] - begin_at) / max(1.0, hard_bytes * target / hard_tokens))
        best = int(k[np.argmax(kind * 4 - np.abs(along - 1))])
        out.append((begin_at, int(stop[best]), int(rank[best])))
        at = best + 1
        lead = step_back(at)
        begin_at = int(start[lead]) if lead < at else int(stop[best])
    return out


def _cut(segment_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                raw = bytes(r.raw)
                t = atom_table(raw, r.base, r.begin, r.base + len(raw), _atom_bytes(r.hard_max_bytes))
                for grid in range(r.begin, min(r.end, max(r.bytes, 1)), segment_bytes):
                    first = 0 if grid == 0 else _anchor(t, grid, r.hard_max_bytes)
                    last = len(t) if grid + segment_bytes >= r.bytes else _anchor(t, grid + segment_bytes, r.hard_max_bytes)
                    if first >= last:
                        continue
                    begin = 0 if grid == 0 else int(t["stop"].iloc[first - 1])
                    end = r.bytes if last == len(t) and r.base + len(raw) >= r.bytes else int(t["stop"].iloc[last - 1])
                    for k, (a, b, rank) in enumerate(cut_segment(t, first, last, begin, end, r.target_tokens, r.hard_max_tokens, r.overlap_tokens, r.hard_max_bytes)):
                        text = raw[a - r.base : b - r.base].decode()
                        rows.append((r.chunk_id, grid // segment_bytes, k, a, b - a, count_tokens(text), NAMES[rank if b < r.bytes else BLOCK], text))
            yield pd.DataFrame(rows, columns=["chunk_id", "segment", "k", "chunk_offset", "byte_length", "tokens", "ends_at", "text"])

    return run


def _ranges(chunks: DataFrame, range_bytes: int) -> DataFrame:
    halo = F.col("hard_max_bytes").cast("bigint") * 2 + 1024
    last = F.greatest((F.octet_length("_bin").cast("bigint") - 1), F.lit(0))
    df = chunks.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / range_bytes))))
    df = df.withColumns({"begin": F.col("range_no") * range_bytes, "end": (F.col("range_no") + 1) * range_bytes}).withColumn("base", F.greatest(F.col("begin") - halo, F.lit(0)))
    return df.withColumn("raw", F.substring("_bin", (F.col("base") + 1).cast("int"), (F.col("end") - F.col("base") + halo).cast("int")))


def split_oversized(chunks: DataFrame, policies: DataFrame, range_bytes: int = RANGE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Pieces of every chunk over the limits of its extractor, each chunk_id once.

    Columns: chunk_id, doc_id, seq, piece (from 0), byte_offset (in the document, null where the chunk has none),
    chunk_offset (bytes in the chunk), byte_length, tokens, heading, kind, ends_at, text. A piece ends at the sentence,
    line or block end within the limits that lies nearest to the target, else at a clause, else at a word, and inside a token
    only where that alone exceeds the limits. Consecutive pieces share overlap_tokens tokens, fewer only where behind these no
    further token would fit into the bytes (of a giant one, half a piece) or fewer stand before them; inside a token that exceeds the limits they
    share its last characters instead, as many bytes as so many tokens of a full piece take. Together the pieces cover the chunk. ``range_bytes`` is
    rounded up to whole segments. Chunks with null text or id, or without a policy,
    have no limits and no pieces; of repeated rows of one chunk_id one counts. Further columns of either table are left out.
    """
    range_bytes = -(-range_bytes // segment_bytes) * segment_bytes
    limits = policies.where("extractor_key is not null").groupBy("extractor_key").agg(*[F.max(F.col(c).cast("bigint")).alias(c) for c in ("target_tokens", "hard_max_tokens", "overlap_tokens", "hard_max_bytes")])
    base = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "doc_id", "seq", "byte_offset", "heading", "kind", "extractor_key", "text")
    maybe = base.join(F.broadcast(limits) if len(limits.head(1001)) <= 1000 else limits, "extractor_key").where("octet_length(text) > hard_max_bytes or octet_length(text) > 2 * hard_max_tokens")
    sized = _ranges(maybe.withColumn("_bin", F.encode("text", "UTF-8")), range_bytes).select(
        "chunk_id", "range_no", "base", "begin", "end", "raw", "hard_max_tokens", "hard_max_bytes", "overlap_tokens", "target_tokens", F.octet_length("_bin").cast("bigint").alias("bytes")
    )
    measured = sized.select("chunk_id", "range_no", "base", "begin", "end", "raw").mapInPandas(_measure, "chunk_id bigint, range_no bigint, tokens bigint")
    totals = measured.groupBy("chunk_id", "range_no").agg(F.max("tokens").alias("tokens")).groupBy(F.col("chunk_id").alias("_id")).agg(F.sum("tokens").alias("total"))
    over = sized.join(totals, F.col("chunk_id") == F.col("_id")).where("bytes > hard_max_bytes or total > hard_max_tokens").drop("_id", "total")
    over = over.dropDuplicates(["chunk_id", "range_no"])
    pieces = materialize(over.mapInPandas(_cut(segment_bytes), "chunk_id bigint, segment bigint, k bigint, chunk_offset bigint, byte_length bigint, tokens bigint, ends_at string, text string"), "pieces")
    order = Window.partitionBy("chunk_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    numbers = pieces.groupBy("chunk_id", "segment").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    head = maybe.select("chunk_id", "doc_id", "seq", "byte_offset", "heading", "kind").dropDuplicates(["chunk_id"])
    return pieces.join(numbers, ["chunk_id", "segment"]).join(head, "chunk_id").select(
        "chunk_id", "doc_id", "seq", (F.col("before") + F.col("k")).alias("piece"), (F.col("byte_offset") + F.col("chunk_offset")).alias("byte_offset"), "chunk_offset", "byte_length", "tokens", "heading", "kind", "ends_at", "text"
    )


def piece_faults(pieces: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, bytes, covered, over_limits, wrong_texts) of chunks (chunk_id, whole, hard_max_tokens, hard_max_bytes).

    ``covered`` are the bytes up to which the pieces follow each other without a gap; ``over_limits`` counts pieces over a
    limit, ``wrong_texts`` those that are no slice of the chunk at their offset.
    """
    order = Window.partitionBy("chunk_id").orderBy("piece")
    end = F.col("chunk_offset") + F.col("byte_length")
    p = pieces.withColumns({"_gap": F.col("chunk_offset") > F.coalesce(F.lag(end).over(order), F.lit(0)), "_end": end}).join(chunks, "chunk_id")
    own = F.substring(F.encode("whole", "UTF-8"), (F.col("chunk_offset") + 1).cast("int"), F.col("byte_length").cast("int"))
    tokens = F.size(F.filter(F.split("text", "[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"), lambda t: t != ""))
    p = p.withColumns({"_over": (F.octet_length("text") > F.col("hard_max_bytes")) | (tokens > F.col("hard_max_tokens")), "_wrong": F.encode("text", "UTF-8") != own})
    gap = F.coalesce(F.min(F.when(F.col("_gap"), F.col("chunk_offset"))), F.max("_end"))
    return p.groupBy("chunk_id").agg(F.max(F.octet_length("whole").cast("bigint")).alias("bytes"), F.least(gap, F.max("_end")).alias("covered"), F.count_if("_over").alias("over_limits"), F.count_if("_wrong").alias("wrong_texts"))
