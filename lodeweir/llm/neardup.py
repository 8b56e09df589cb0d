"""Near-duplicates with small edits (problem 5): a prefix-tree join of globally ordered n-gram sets.

Every text is the set of its n-grams, ordered from rare to frequent over the whole collection. Two sets with Jaccard
similarity t share one of the first n - ceil(t n) + 1 n-grams of each, so a set is sent to the groups of these
n-grams, with the codes of the next few. A worker stores the sets of its groups in one trie and joins the trie with
itself: node pairs advance together, so that shared beginnings are compared once, and a pair of subtrees is pruned as
soon as the n-grams missed so far exceed what the sizes below allow. Surviving pairs are compared by parity bitmaps,
whose distance never exceeds that of the sets, and at last on the whole sets.

Frequencies come from counters of hashed n-grams, whose number is bounded: n-grams that share a counter count as
equally frequent, which moves them in the order and changes no result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweir.session import broadcast_if_small, materialize

#: Words per n-gram, least similarity and least words for problem 5 as stated in its data.
NGRAM, THRESHOLD, LEAST_WORDS = 3, 0.7, 30
#: Sets of one n-gram's group in one task; larger groups are split into blocks that meet pairwise.
BLOCK_SETS = 2000
#: Node pairs in the air at once; records joined at once.
FRONTIER, RECORDS = 1_500_000, 300_000
#: Members of a class in one block when classes are expanded into pairs; blocks meet pairwise.
EXPAND_BLOCK = 1000
#: Codes of 16 bits that travel behind an n-gram; bits of a set's parity bitmap; most bits of a counter's number.
DEPTH, BITMAP, MOST_BITS = 4, 512, 24
#: Counters of a block; head ids that are broadcast (checked by a count).
_COUNTERS, _FEW = 1 << 16, 1_000_000
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_WORDS = [f"b{i}" for i in range(BITMAP // 64)]


def prefix_length(n: int, threshold: float) -> int:
    """N-grams of a set's prefix."""
    return n - math.ceil(threshold * n - 1e-9) + 1


# -- n-gram sets of many texts at once


class _Tables:
    """Word characters by code point, and powers of the hash's base; grown as needed."""

    def __init__(self):
        self.word, self.power, self.inverse = np.zeros(0, bool), np.ones(1, "uint64"), np.ones(1, "uint64")

    def need(self, code_points: int, length: int) -> None:
        """Tables for characters below ``code_points`` and texts of ``length``."""
        if code_points > len(self.word):
            upto = min(0x110000, max(0x3000, 2 * code_points))
            self.word = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(upto)], bool)
        if length > len(self.power):
            n = 1 << length.bit_length()
            self.power, self.inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, p, "uint64")]) for p in (_P, _P_INVERSE))


_TABLES = _Tables()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(29))


def gram_sets(texts: list[str], ngram: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, offsets): text i has the ascending distinct 64-bit hashes grams[offsets[i]:offsets[i + 1]], none where it is too short.

    Words are maximal runs of letters and digits (Unicode L, N) of the lower-cased text; no Python code runs per word.
    """
    low = [t.lower() for t in texts]
    at = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in low])].astype("int64")
    _TABLES.need(int(at.max(initial=0)) + 1, len(at) + 1)
    inside = np.r_[False, _TABLES.word[at], False]
    first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    total = np.r_[np.uint64(0), np.cumsum((at.astype("uint64") + np.uint64(1)) * _TABLES.power[: len(at)], dtype="uint64")]
    word = _mix((total[last] - total[first]) * _TABLES.inverse[first] + (last - first).astype("uint64"))
    doc = np.searchsorted(begin, first, "right") - 1
    enough = np.bincount(doc, minlength=len(texts)) >= max(least_words, ngram)
    n = len(word) - ngram + 1
    if n <= 0:
        return np.zeros(0, "uint64"), np.zeros(len(texts) + 1, "int64")
    gram = np.zeros(n, "uint64")
    for k in range(ngram):
        gram = _mix(gram * _M1 + word[k : k + n])
    own = doc[:n]
    ok = (own == doc[ngram - 1 :]) & enough[own]
    gram, own = gram[ok], own[ok]
    order = np.argsort(gram)
    order = order[np.argsort(own[order].astype("int16" if len(texts) < 1 << 15 else "int64"), kind="stable")]
    gram, own = gram[order], own[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])] if len(gram) else np.zeros(0, bool)
    gram, own = gram[new], own[new]
    return gram, np.r_[0, np.cumsum(np.bincount(own, minlength=len(texts)))].astype("int64")


def _sets(ngram: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                gram, offset = gram_sets(part["text"].tolist(), ngram, least_words)
                n = np.diff(offset)
                kept = np.flatnonzero(n)
                if not len(kept):
                    continue
                own = np.repeat(np.arange(len(n)), n)
                parity = np.bincount(own * BITMAP + (gram % np.uint64(BITMAP)).astype("int64"), minlength=len(n) * BITMAP) & 1
                bits = np.packbits(parity.astype("uint8").reshape(-1, BITMAP), axis=1).view("int64")[kept]
                h1, h2 = (np.add.reduceat(f, offset[kept]).view("int64") for f in (_mix(gram + _P), _mix(gram ^ _M1)))
                raw = gram.tobytes()
                out = part[["uid", "id", "content"]].iloc[kept].reset_index(drop=True)
                out["n"], out["h1"], out["h2"] = n[kept].astype("int32"), h1, h2
                for i, name in enumerate(_WORDS):
                    out[name] = bits[:, i]
                out["grams"] = [raw[8 * a : 8 * b] for a, b in zip(offset[kept], offset[kept + 1], strict=True)]
                yield out

    return run


def _flat(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, set of each) of a batch of binary sets."""
    n = sets.map(len).to_numpy().astype("int64") // 8
    return np.frombuffer(b"".join(sets), "uint64"), np.repeat(np.arange(len(n)), n)


# -- the order of n-grams


def _count(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, "uint32")
        for pdf in batches:
            gram, _ = _flat(pdf["grams"])
            hit, n = np.unique((gram >> np.uint64(64 - bits)).astype("int64"), return_counts=True)
            total[hit] += n.astype("uint32")
        for block in range(0, 1 << bits, _COUNTERS):
            hit = np.flatnonzero(total[block : block + _COUNTERS])
            if len(hit):
                yield pd.DataFrame({"block": [block // _COUNTERS], "hit": [hit.astype("uint16").tobytes()], "n": [total[block + hit].tobytes()]})

    return run


def _level(pdf: pd.DataFrame) -> pd.DataFrame:
    """Four times the binary logarithm of a block's sums, in a byte."""
    total = np.zeros(_COUNTERS, "uint64")
    for hit, n in zip(pdf["hit"], pdf["n"], strict=True):
        total[np.frombuffer(hit, "uint16")] += np.frombuffer(n, "uint32")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "level": [np.floor(4 * np.log2(np.maximum(total, 1))).astype("uint8").tobytes()]})


def gram_levels(sets: DataFrame, grams: int) -> tuple[int, np.ndarray]:
    """(bits, level of each counter) of binary sets with so many n-grams: at most 2^MOST_BITS bytes, whatever the collection."""
    bits = max(16, min(MOST_BITS, grams.bit_length()))
    blocks = sets.select("grams").mapInPandas(_count(bits), "block int, hit binary, n binary").groupBy("block").applyInPandas(_level, "block int, level binary")
    level = np.zeros(1 << bits, "uint8")
    for r in blocks.collect():  # one byte per counter
        level[r["block"] * _COUNTERS : (r["block"] + 1) * _COUNTERS] = np.frombuffer(r["level"], "uint8")
    return bits, level


def hot_grams(sets: DataFrame, bits: int, level: np.ndarray, block_sets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(block size, n-grams in more sets than that, their numbers of sets), counted exactly where a counter exceeds it.

    The block size is doubled until at most _FEW n-grams are hot, which changes how work is split and no result.
    """
    while True:
        busy = level >= 4 * math.log2(block_sets + 1) - 1
        if not busy.any():
            return block_sets, np.zeros(0, "uint64"), np.zeros(0, "int64")
        share = sets.sparkSession.sparkContext.broadcast(busy)

        def run(batches: Iterator[pd.DataFrame], share=share) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                gram, _ = _flat(pdf["grams"])
                gram, n = np.unique(gram[share.value[(gram >> np.uint64(64 - bits)).astype("int64")]], return_counts=True)
                yield pd.DataFrame({"gram": gram.view("int64"), "n": n})

        hot = sets.select("grams").mapInPandas(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > block_sets)
        found = hot.limit(_FEW + 1).toPandas()
        if len(found) <= _FEW:
            gram = found["gram"].to_numpy().astype("int64").view("uint64")
            order = np.argsort(gram)
            return block_sets, gram[order], found["n"].to_numpy().astype("int64")[order]
        block_sets *= 2


def _records(threshold: float, bits: int, level, hot, block_sets: int):
    """Records of a set's prefix: (grp, id, info, tail); info has the size, the position and the side of a split group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, (hot_gram, hot_n) = level.value, hot.value
        top = max(31, int(levels.max(initial=0)))
        classes = np.where(np.arange(256) == 0, 0, 1 + (np.arange(256) - 1) * 30 // top).clip(0, 31).astype("uint64")
        for pdf in batches:
            gram, own = _flat(pdf["grams"])
            key = (classes[levels[(gram >> np.uint64(64 - bits)).astype("int64")]] << np.uint64(59)) | (gram >> np.uint64(5))
            order = np.lexsort((key, own))
            key, gram = key[order], gram[order]
            n = np.bincount(own, minlength=len(pdf))
            begin = np.r_[0, np.cumsum(n)][:-1]
            position = np.arange(len(key)) - begin[own]
            keep = n - np.ceil(threshold * n - 1e-9).astype("int64") + 1
            at = np.flatnonzero((position < keep[own]) & (key >> np.uint64(59) > 0))  # class 0: in one set alone
            code = np.r_[(key >> np.uint64(48)), np.full(DEPTH, 0xFFFF, "uint64")]
            left = (n[own] - position)[at]
            tail = np.zeros(len(at), "uint64")
            for k in range(1, DEPTH + 1):
                tail = (tail << np.uint64(16)) | np.where(k < left, code[at + k], np.uint64(0xFFFF))
            ids, size, place, grp = pdf["id"].to_numpy()[own[at]], n[own[at]], position[at], key[at]
            side = np.zeros(len(at), "int64")
            if len(hot_gram):
                where = np.searchsorted(hot_gram, gram[at]).clip(0, len(hot_gram) - 1)
                blocks = np.where(hot_gram[where] == gram[at], -(-hot_n[where] // block_sets), 1)
                mine = (_mix(ids.astype("int64").view("uint64") + _P) % blocks.astype("uint64")).astype("int64")
                row = np.repeat(np.arange(len(at)), blocks)
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
                side = np.where(low == high, 0, np.where(mine[row] == low, 1, 2))
                cell = _mix(grp[row] + low.astype("uint64") * _M1 + high.astype("uint64") * _M2)
                grp, ids, size, place, tail = np.where(blocks[row] > 1, cell, grp[row]), ids[row], size[row], place[row], tail[row]
            yield pd.DataFrame({"grp": grp.view("int64"), "id": ids, "info": (size << 32) | (place << 2) | side, "tail": tail.view("int64")})

    return run


# -- the trie


class Trie:
    """Prefix tree of rows (group, codes...), built level by level from the sorted rows; all rows end at the last level."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, size: np.ndarray, position: np.ndarray, tau: float):
        """``codes`` has a row of ascending codes for each row; rows are sorted by group and codes."""
        n, depth = codes.shape
        self.tau, self.size, self.position = tau, size, position
        new = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        lo, hi, token, first, count, made = [], [], [], [], [], 0
        for level in range(depth + 1):
            if level:
                new = new.copy()
                new[1:] |= codes[1:, level - 1] != codes[:-1, level - 1]
            at = np.flatnonzero(new)
            lo.append(at)
            hi.append(np.r_[at[1:], n])
            token.append(codes[at, level - 1] if level else np.full(len(at), -1, "int64"))
            if level:  # children of the level above are contiguous
                begin = np.searchsorted(at, lo[-2])
                first.append(made + begin)
                count.append(np.diff(np.r_[begin, len(at)]))
            made += len(at)
        last = len(lo[-1])
        self.roots = np.arange(len(lo[0]))
        self.first_child, self.n_children = np.concatenate([*first, np.zeros(last, "int64")]), np.concatenate([*count, np.zeros(last, "int64")])
        slack = (1 - tau) * size - position
        self.slack = np.concatenate([np.maximum.reduceat(slack, x) for x in lo]) if n else np.zeros(0)
        self.least = np.concatenate([np.minimum.reduceat(size, x) for x in lo]) if n else np.zeros(0)
        self.lo, self.hi, self.token = np.concatenate(lo), np.concatenate(hi), np.concatenate(token)
        self.first_leaf = made - last


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the span, first + 0..count) for each span, flattened."""
    which = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, first[which] + within


def join_trie(t: Trie, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a, b), a and b of one group, whose codes do not rule out the threshold."""
    work = np.cumsum((t.hi - t.lo)[t.roots].astype("int64") ** 2)
    parts = np.split(t.roots, np.flatnonzero(np.diff(work // frontier)) + 1) if len(t.roots) else []
    for roots in parts:
        roots = roots[(t.hi - t.lo)[roots] > 1]
        stack = [(roots, roots, np.zeros(len(roots), "int64"), np.zeros(len(roots), "int64"))]
        while stack:
            a, b, ma, mb = stack.pop()
            if len(a) > frontier:
                half = len(a) // 2
                stack += [(a[:half], b[:half], ma[:half], mb[:half]), (a[half:], b[half:], ma[half:], mb[half:])]
                continue
            ok = (ma <= t.slack[a] - t.tau * t.least[b] + 1e-6) & (mb <= t.slack[b] - t.tau * t.least[a] + 1e-6)
            a, b, ma, mb = a[ok], b[ok], ma[ok], mb[ok]
            if not len(a):
                continue
            ta, tb = t.token[a], t.token[b]
            # where a leaf's code is consumed nothing is known of its rows any more: they meet all rows of the other node
            done = np.flatnonzero(((a >= t.first_leaf) & (ta <= tb)) | ((b >= t.first_leaf) & (tb <= ta)))
            if len(done):
                which, p = _spans(t.lo[a[done]], (t.hi - t.lo)[a[done]])
                k = done[which]
                which, q = _spans(t.lo[b[k]], (t.hi - t.lo)[b[k]])
                p, k = p[which], k[which]
                common = t.tau * (t.size[p] + t.size[q]) - 1e-6
                fits = ((a[k] != b[k]) | (p < q)) & (ma[k] + t.position[p] <= t.size[p] - common) & (mb[k] + t.position[q] <= t.size[q] - common)
                yield p[fits], q[fits]
                rest = np.ones(len(a), bool)
                rest[done] = False
                a, b, ma, mb, ta, tb = a[rest], b[rest], ma[rest], mb[rest], ta[rest], tb[rest]
            only_a, only_b, both = np.flatnonzero(ta < tb), np.flatnonzero(tb < ta), np.flatnonzero(ta == tb)
            which, at = _spans(t.first_child[a[only_a]], t.n_children[a[only_a]])
            k = only_a[which]
            out = [(at, b[k], ma[k] + 1, mb[k])]
            which, at = _spans(t.first_child[b[only_b]], t.n_children[b[only_b]])
            k = only_b[which]
            out.append((a[k], at, ma[k], mb[k] + 1))
            which, left = _spans(t.first_child[a[both]], t.n_children[a[both]])
            k = both[which]
            which, right = _spans(t.first_child[b[k]], t.n_children[b[k]])
            left, k = left[which], k[which]
            keep = ((a[k] != b[k]) | (left < right)) | ((left == right) & ((t.hi - t.lo)[left] > 1))
            out.append((left[keep], right[keep], ma[k][keep], mb[k][keep]))
            joined = tuple(np.concatenate(c) for c in zip(*out, strict=True))
            if len(joined[0]):
                stack.append(joined)


def _candidates(threshold: float):
    tau = threshold / (1 + threshold)

    def joined(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, ids, info, tail = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("grp", "id", "info", "tail"))
        raw = tail.view("uint64")
        codes = np.stack([((raw >> np.uint64(16 * (DEPTH - 1 - k))) & np.uint64(0xFFFF)).astype("int64") for k in range(DEPTH)], axis=1)
        side = info & 3
        trie = Trie(grp, codes, (info >> 32).astype("float64"), ((info >> 2) & 0x3FFFFFFF).astype("float64"), tau)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for p, q in join_trie(trie):
            keep = (side[p] == 0) | (side[p] != side[q])
            found.append((ids[p[keep]], ids[q[keep]]))
            n += int(keep.sum())
            if n > FRONTIER:
                yield distinct(found)
                found, n = [], 0
        if found:
            yield distinct(found)

    def distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        out = pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})
        return out[out["a"] < out["b"]].drop_duplicates()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows, carry = 0, None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            whole = (pdf["grp"] != pdf["grp"].iloc[-1]).to_numpy()  # the last group may go on in the next batch
            carry = pdf[~whole]
            if whole.any():
                held.append(pdf[whole])
                rows += int(whole.sum())
            if rows > RECORDS:
                yield from joined(held)
                held, rows = [], 0
        if carry is not None:
            held.append(carry)
        if held:
            yield from joined(held)

    return pairs


def _exact(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ga, gb in zip(pdf["ga"], pdf["gb"], strict=True):
                x, y = np.frombuffer(ga, "uint64"), np.frombuffer(gb, "uint64")
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(common / (len(x) + len(y) - common))
            pdf = pdf[["a", "b"]].assign(similarity=np.array(out, "float64"))
            yield pdf[pdf["similarity"] >= threshold - 1e-12]

    return run


def similar_sets(sets: DataFrame, grams: int, threshold: float, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of ``sets`` (id, n, bitmap, grams; different sets) with Jaccard similarity >= threshold.

    ``grams`` is the number of n-grams of all sets.
    """
    spark = sets.sparkSession
    bits, level = gram_levels(sets, grams)
    block_sets, *hot = hot_grams(sets, bits, level, block_sets)
    share = spark.sparkContext.broadcast
    records = sets.select("id", "grams").mapInPandas(_records(threshold, bits, share(level), share(tuple(hot)), block_sets), "grp bigint, id bigint, info bigint, tail bigint")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 2)
    found = records.repartition(parts, "grp").sortWithinPartitions("grp", "tail").mapInPandas(_candidates(threshold), "a bigint, b bigint").distinct()
    maps = sets.select("id", "n", *_WORDS)
    for end in "ab":
        found = found.join(maps.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), *[F.col(w).alias(f"{w}_{end}") for w in _WORDS]), end)
    distance = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS[1:]), F.bit_count(F.col(f"{_WORDS[0]}_a").bitwiseXOR(F.col(f"{_WORDS[0]}_b"))))
    found = materialize(found.where(distance <= (F.col("n_a") + F.col("n_b")) * (1 - threshold) / (1 + threshold) + 1e-6).select("a", "b"), "candidates")
    named = broadcast_if_small(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), _FEW)
    few = sets.select("id", "grams").join(named, "id", "left_semi")
    for end in "ab":
        found = found.join(few.select(F.col("id").alias(end), F.col("grams").alias(f"g{end}")), end)
    return found.select("a", "b", "ga", "gb").mapInPandas(_exact(threshold), "a bigint, b bigint, similarity double")


def near_duplicate_links(texts: DataFrame, key: str, text: str, *, ngram: int = NGRAM, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, block_sets: int = BLOCK_SETS) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of equal n-gram sets as (key, class_id, content), and (a, b, similarity) between class ids.

    The class id is the least key. Null and short texts and null keys belong to no class; repeated rows of a key
    count once (of different texts under one key the set with the most n-grams counts). Keys are integers. Both tables are written.
    """
    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    schema = "uid bigint, id bigint, content bigint, n int, h1 bigint, h2 bigint, " + ", ".join(f"{w} bigint" for w in _WORDS) + ", grams binary"
    sets = materialize(rows.mapInPandas(_sets(ngram, least_words), schema), "grams")
    once = sets.groupBy("id").agg(F.max(F.struct("n", "h1", "h2", "content", "uid")).alias("r")).select("id", "r.*")
    classes = once.groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    told = materialize(once.join(classes, ["h1", "h2"]).select("id", "class_id", "content", "uid", "n"), "classes")
    first = told.where("id = class_id")
    grams = int(first.agg(F.sum("n")).first()[0] or 0)
    heads = sets.join(broadcast_if_small(first.select("uid"), _FEW), "uid", "left_semi")
    return told.select(F.col("id").alias(key), "class_id", "content"), materialize(similar_sets(heads, grams, threshold, block_sets), "links")


def expand_pairs(members: DataFrame, links: DataFrame, key: str, expand: int | None = None, block: int = EXPAND_BLOCK) -> DataFrame:
    """(response_a, response_b): all pairs of keys of one class or of linked classes, at every size of the classes.

    Classes are cut into salted blocks of about ``block`` members, and pairs of blocks are the units of the joins. Only
    where ``expand`` is given do more than ``expand`` texts of identical content count as their representative (the
    least key), to which each further one is linked; different texts of one n-gram set are always paired.
    """
    acting = members.select(F.col(key).alias("_k"), "class_id", "content")
    star = None
    if expand is not None:
        copies = acting.groupBy("class_id", "content").agg(F.count("*").alias("copies"), F.min("_k").alias("first"))
        told = materialize(acting.join(copies, ["class_id", "content"]), "told")
        acting = told.where((F.col("copies") <= expand) | (F.col("_k") == F.col("first")))
        star = told.where((F.col("copies") > expand) & (F.col("_k") != F.col("first"))).select(F.col("first").alias("x"), F.col("_k").alias("y"))
    sizes = acting.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sized = materialize(acting.join(sizes, "class_id").select("_k", "class_id", "n", "blocks", F.pmod(F.xxhash64("_k"), "blocks").cast("int").alias("side")), "copies")
    large = sized.where("blocks > 1").select("class_id", "blocks").distinct()
    large = broadcast_if_small(materialize(large, "large"), 100_000)
    cells = links.select("a", "b")
    for end, side in (("a", "i"), ("b", "j")):
        cells = cells.join(large.withColumnRenamed("class_id", end), end, "left").withColumn(side, F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    x, y = sized.select(F.col("_k").alias("x"), F.col("class_id").alias("a"), F.col("side").alias("i")), sized.select(F.col("_k").alias("y"), F.col("class_id").alias("b"), F.col("side").alias("j"))
    # written before the union: joins under one union may differ in their numbers of partitions
    across = materialize(cells.join(x, ["a", "i"]).join(y, ["b", "j"]).select("x", "y"), "across")
    multi, others = sized.where("n > 1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    p, q = multi.select(F.col("_k").alias("x"), "class_id", F.col("side").alias("i"), others.alias("j")), multi.select(F.col("_k").alias("y"), "class_id", others.alias("i"), F.col("side").alias("j"))
    within = materialize(p.join(q, ["class_id", "i", "j"]).where("x < y").select("x", "y"), "within")
    pairs = across.unionByName(within)
    pairs = pairs if star is None else pairs.unionByName(star)
    return pairs.select(F.least("x", "y").alias("response_a"), F.greatest("x", "y").alias("response_b"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): least node of each connected component, by alternating large and small stars over written tables."""
    both = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    for _ in range(rounds):
        sym = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(small_m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "stars")
        if not after.exceptAll(both).head(1) and not both.exceptAll(after).head(1):
            break
        both = after
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return nodes.join(both.groupBy("u").agg(F.min("v").alias("component")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicate_groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, class_id, group_id, links): every text with its class of copies, its group of near-duplicates (least class
    id over chains of links) and the number of links of its class."""
    ends = links.select(F.col("a").alias("c")).unionByName(links.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("links"))
    group = components(members.select(F.col("class_id").alias("node")).distinct(), links).withColumnRenamed("node", "class_id")
    return members.join(group, "class_id").join(ends, F.col("class_id") == F.col("c"), "left").select(key, "class_id", F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
