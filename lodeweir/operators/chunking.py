"""Structure-aware chunks of canonical documents: packing of blocks, forced splits, overlap, table prefixes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?][\"')\]}]*$")
_CLAUSE = re.compile(r"[,;:][\"')\]}]*$")
#: What may be packed together.
_CLASS = {"Heading": "narrative", "Paragraph": "narrative", "ListItem": "narrative", "BlockQuote": "narrative", "CodeFence": "code", "TableHeader": "table", "TableRow": "table", "HtmlBlock": "opaque"}


@dataclass(frozen=True)
class ChunkPolicy:
    """Sizes in tokens. The defaults, and those of the code profile."""

    target: int = 800
    soft_max: int = 950
    hard_max: int = 1200
    overlap: int = 48
    contextual_prefix: bool = True

    def normalized(self) -> ChunkPolicy:
        """target >= 1, soft >= target, hard >= soft, overlap below hard."""
        target = max(1, self.target)
        soft = max(target, self.soft_max)
        hard = max(soft, self.hard_max)
        return ChunkPolicy(target, soft, hard, min(max(0, self.overlap), hard - 1), self.contextual_prefix)


PROFILES = {"code": ChunkPolicy(320, 420, 560, 24)}


def resolve_policy(extractor: str, override: ChunkPolicy | None = None, profiles: dict[str, ChunkPolicy] | None = None) -> ChunkPolicy:
    """Override, else the extractor's profile, else the defaults."""
    return (override or (PROFILES | (profiles or {})).get(extractor.strip().lower()) or ChunkPolicy()).normalized()


def generation_key(extractor: str, version: int, policy: ChunkPolicy) -> str:
    """Key of everything that decides what chunks a source gets."""
    p = policy
    return f"canonical:v1;chunker:v2;{extractor}:v{version};target={p.target};soft={p.soft_max};hard={p.hard_max};overlap={p.overlap};prefix={str(p.contextual_prefix).lower()}"


def count_tokens(text: str) -> int:
    """Tokens between white space."""
    return len(_TOKEN.findall(text))


def _windows(text: str, policy: ChunkPolicy, choose: Callable[[list[re.Match], int, int], int]) -> list[tuple[int, int]]:
    """Spans of ``text`` of at most hard_max tokens; ``choose`` picks the last token of each, the next one starts overlap tokens before."""
    tokens = list(_TOKEN.finditer(text))
    out, first = [], 0
    while first < len(tokens):
        limit = min(first + policy.hard_max, len(tokens))
        last = limit if limit == len(tokens) else choose(tokens, first, limit)
        out.append((tokens[first].start(), tokens[last - 1].end()))
        if last == len(tokens):
            break
        first = max(first + 1, last - policy.overlap)
    return out


def _best_boundary(policy: ChunkPolicy) -> Callable[[list[re.Match], int, int], int]:
    def choose(tokens: list[re.Match], first: int, limit: int) -> int:
        best, score = limit, -10 * abs(limit - first - policy.target)
        for k in range(first + 1, limit + 1):
            word = tokens[k - 1].group()
            bonus = 30 if _SENTENCE.search(word) else 15 if _CLAUSE.search(word) else None
            if bonus is not None and bonus - 10 * abs(k - first - policy.target) >= score:
                best, score = k, bonus - 10 * abs(k - first - policy.target)
        return max(best, min(limit, first + policy.overlap + 1))

    return choose


def split_block(block: dict, policy: ChunkPolicy) -> list[dict]:
    """A block over the hard limit as parts within it: code at empty lines, prose at the best sentence or clause end, else windows.

    White space after the last token belongs to no part.
    """
    text, kind = block["text"], _CLASS.get(block["kind"], "opaque")
    if count_tokens(text) <= policy.hard_max:
        return [block]
    if kind == "code":
        groups = [(m.start(), m.end()) for m in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|$))+", text)]
        spans: list[tuple[int, int]] = []
        for s, e in groups:
            if spans and count_tokens(text[spans[-1][0] : e]) <= policy.hard_max:
                spans[-1] = (spans[-1][0], e)
            else:
                spans.append((s, e))
        spans = [(s + a, s + b) for s, e in spans for a, b in ([(0, e - s)] if count_tokens(text[s:e]) <= policy.hard_max else _windows(text[s:e], policy, lambda t, f, lim: lim))]
        spans = [(s, s + len(text[s:e].rstrip("\n"))) for s, e in spans]
    else:
        spans = _windows(text, policy, _best_boundary(policy) if kind == "narrative" else (lambda t, f, lim: lim))
    places = [0]
    for ch in text:
        places.append(places[-1] + len(ch.encode()))
    return [{**block, "text": text[s:e], "offset": block["offset"] + places[s], "length": places[e] - places[s]} for s, e in spans]


def _fits(a: list[dict], b: dict) -> bool:
    last = a[-1]
    if _CLASS.get(last["kind"], "opaque") != _CLASS.get(b["kind"], "opaque") or _CLASS.get(b["kind"], "opaque") == "opaque" or b["kind"] == "Heading":
        return False
    return last["kind"] == "Heading" or last["heading_path"] == b["heading_path"]


def _kind(blocks: list[dict]) -> str:
    kinds = {b["kind"] for b in blocks}
    if kinds <= {"CodeFence"}:
        return "code"
    if kinds <= {"TableHeader", "TableRow"}:
        return "table"
    if "Heading" in kinds and kinds <= {"Heading", "Paragraph", "ListItem", "BlockQuote"}:
        return "section"
    return "paragraph" if kinds <= {"Paragraph", "ListItem", "BlockQuote"} else "mixed"


def chunk_blocks(text: str, blocks: list[dict], policy: ChunkPolicy) -> list[dict]:
    """Chunks (seq, text, offset, length, heading, kind, retrieval_prefix) of a canonical document: adjacent compatible blocks
    packed up to soft_max tokens; texts are exact slices of the document."""
    policy = policy.normalized()
    raw = text.encode()
    groups: list[list[dict]] = []
    header, headers = "", {}
    for block in blocks:
        header = block["text"] if block["kind"] == "TableHeader" else header if block["kind"] == "TableRow" else ""
        for part in split_block(block, policy):
            headers[id(part)] = header
            whole = groups[-1] + [part] if groups else []
            if groups and _fits(groups[-1], part) and part["offset"] >= groups[-1][-1]["offset"] + groups[-1][-1]["length"] and count_tokens(raw[whole[0]["offset"] : part["offset"] + part["length"]].decode()) <= policy.soft_max:
                groups[-1].append(part)
            else:
                groups.append([part])
    out = []
    for seq, g in enumerate(groups):
        start, end = g[0]["offset"], g[-1]["offset"] + g[-1]["length"]
        body = raw[start:end].decode()
        heading = next((" > ".join(b["heading_path"]) for b in reversed(g) if b["heading_path"]), None)
        top = headers[id(g[0])]
        prefix = top if g[0]["kind"] == "TableRow" and top.strip() and count_tokens(top) < policy.hard_max and not body.startswith(top) else None
        out.append({"seq": seq, "text": body, "offset": start, "length": end - start, "heading": heading, "kind": _kind(g), "retrieval_prefix": prefix})
    return out


def chunk_documents(extracted: DataFrame, policies: dict[str, ChunkPolicy] | None = None) -> DataFrame:
    """Chunks of extracted documents (doc_id, extractor_key, text, blocks); documents stay whole in one task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                blocks = [{**b, "heading_path": list(b["heading_path"])} for b in r.blocks]
                rows += [(r.doc_id, c["seq"], c["offset"], c["length"], c["heading"], c["kind"], c["retrieval_prefix"], c["text"]) for c in chunk_blocks(r.text, blocks, resolve_policy(r.extractor_key or "", None, policies))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "offset", "length", "heading", "kind", "retrieval_prefix", "text"])

    return extracted.select("doc_id", "extractor_key", "text", "blocks").mapInPandas(run, "doc_id bigint, seq int, offset bigint, length bigint, heading string, kind string, retrieval_prefix string, text string")


def token_windows(texts: DataFrame, key: str, text: str, hard_max: int, overlap: int) -> DataFrame:
    """(key, window, first_token, tokens, text): windows of ``hard_max`` tokens that share ``overlap``, in closed form and native."""
    step = max(1, hard_max - overlap)
    toks = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    df = texts.select(key, toks.alias("_t")).where(F.size("_t") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("_t") - hard_max) / F.lit(step)) + 1)
    df = df.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)))
    part = F.slice("_t", (F.col("window") * step + 1).cast("int"), F.lit(hard_max))
    return df.select(key, "window", (F.col("window") * step).alias("first_token"), F.size(part).cast("bigint").alias("tokens"), F.array_join(part, " ").alias("text"))


def bisect_fit(ends: list[int], limit: int) -> int:
    """How many of the ascending ``ends`` lie within ``limit``."""
    return bisect_right(ends, limit)
