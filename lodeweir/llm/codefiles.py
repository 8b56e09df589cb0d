"""Generated, minified, vendored and data files among code (problem 7), from Re-Pair grammars of token sequences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweir.session import materialize

_TOKEN = re.compile(r"[A-Za-z0-9+/=]{40,}|0[xX][0-9a-fA-F]+|[^\W\d]\w*|\d[\d_.]*(?:[eE][-+]?\d+)?\w*|[^\w\s]")
_DIGITS = re.compile(r"\d+")
#: Folders that hold copies of other packages.
_VENDORED_PATH = re.compile(r"(?:^|/)(?:third[_-]?party|3rd[_-]?party|vendor(?:ed|s)?|node_modules|bower_components|deps|external|externals|contrib/libs|site-packages|jspm_packages|Godeps|Pods|Carthage)/[^/]+/", re.IGNORECASE)
#: What files say of themselves in their first or last comment lines.
_SAYS_GENERATED = re.compile(
    r"\bcode generated by\b|@generated\b|\b(?:auto-?generated|automatically generated)\b(?!.{0,40}\b(?:counterpart|elsewhere)\b)|\bgenerated (?:from|by|with|using|on)\b.{0,120}|\b(?:produced|created|written|built) automatically\b"
    r"|\b(?:manual |hand )?(?:changes|edits|modifications)\b.{0,40}\b(?:lost|overwritten|discarded)\b|\bthis file (?:is|was) (?:auto-?)?generated\b|\b(?:re-?generated|rebuilt) (?:on|by|with|from|at|during)\b"
    r"|\bmachine[- ](?:written|generated|made|produced)\b|\b(?:written|emitted|produced|made) by (?:the |an? )?(?:[\w-]+ ){0,3}(?:compiler|generator|codegen)\b",
    re.IGNORECASE,
)
_NOT_GENERATED = re.compile(r"\bnot (?:auto-?)?generated\b|\bgenerated (?:counterpart|files? (?:lives?|are))\b|\bhand-?written\b|\bwritten and maintained by\b|\bcode that\b", re.IGNORECASE)
_SAYS_VENDORED = re.compile(
    r"^\W*!?\s*[\w.@/-]+(?:\.js)?\s+v?\d+(?:\.\d+){1,3}\b(?=\s*(?:$|\*/|[-|(]|copyright|license))|\bupstream (?:copy|tracker|version)\b|\(c\)\s|\bcopyright\b.{0,60}\b(?:contributors|authors|inc|ltd|foundation)\b|\bvendored from\b|\b(?:bundled|vendored|verbatim|imported) copy of\b|\bimported unchanged\b|\bcopied from\b.{0,60}\d+\.\d+|@license\b|\breleased under\b",
    re.IGNORECASE,
)
_COMMENT = re.compile(r"^\s*(?://|#(?!include|!|define|pragma|if|endif)|/\*|\*|--|;|\"\"\"|'''|<!--)(.*)")
#: Grammar size per token below which a file's uniform content shows a tool; fewest tokens and lines for that.
UNIFORM_RATIO, UNIFORM_TOKENS = 0.35, 60
#: Share of a file's characters in literals, and size of the literals' grammar beside that of the same characters in random
#: order, of files that are data: literals that no rule makes smaller.
DATA_LITERALS, DATA_RANDOM = 0.3, 0.7
#: Share of the entropy of random digits that a literal without structure has.
RANDOM_SHARE = 0.9
#: White space per character, and share of one-letter names, of minified files.
MINIFIED_SPACE, MINIFIED_NAMES = 0.06, 0.4
#: Tokens of a rule that counts as shared, repositories that must have it, share and least number of such rules in a file.
SHARED_TOKENS, SHARED_REPOSITORIES, SHARED_SHARE, SHARED_RULES = 12, 3, 0.6, 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _M1 + (b ^ (b >> np.uint64(29))) * _M2
        return (x ^ (x >> np.uint64(32))) * _M1


def repair(symbols: np.ndarray, files: np.ndarray, rounds: int = 24) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Re-Pair grammars of many sequences at once: (final lengths, rules per file, rules (file, rule, tokens, uses)).

    In each round every pair that occurs twice or more in its file, and more often than the pairs that overlap it, is
    replaced; a rule's symbol is a hash of its two parts, so that equal rules of any files have equal symbols.
    """
    n_files = int(files.max()) + 1 if len(files) else 0
    n_rules = np.zeros(n_files, "int64")
    width = np.ones(len(symbols), "int64")
    found = []
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        same = files[1:] == files[:-1]
        pair = _mix(symbols[:-1], symbols[1:])
        key = _mix(pair, files[:-1].astype("uint64"))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        weight = np.where(same, count[inverse], 0)
        weight = np.where(weight >= 2, weight, 0)
        if not weight.any():
            break
        # local maxima, ties to a pseudo-random but fixed order of the pairs, then to the left one of equal pairs
        order = weight.astype("float64") + (pair >> np.uint64(12)).astype("float64") / 2.0**52 * 0.5
        left = np.r_[-1.0, order[:-1]]
        right = np.r_[order[1:], -1.0]
        take = (weight > 0) & (order > left) & (order >= right)
        run = (weight > 0) & (order == left)  # runs of one symbol: every second pair
        if run.any():
            start = np.flatnonzero(~run)
            offset = np.arange(len(run)) - start[np.searchsorted(start, np.arange(len(run)), "right") - 1]
            head_ok = take | run
            take = np.where(run, (offset % 2 == 0) & head_ok[np.maximum(np.arange(len(run)) - offset, 0)], take) & ~np.r_[False, take[:-1] & ~run[1:]]
        at = np.flatnonzero(take)
        at = at[np.r_[True, np.diff(at) > 1]] if len(at) else at
        if not len(at):
            break
        _, inv, cnt = np.unique(key[at], return_inverse=True, return_counts=True)
        at = at[cnt[inv] >= 2]
        if not len(at):
            break
        wide = width[at] + width[at + 1]
        _, first, uses = np.unique(key[at], return_index=True, return_counts=True)
        owner = files[at][first]
        np.add.at(n_rules, owner, 1)
        found.append(pd.DataFrame({"file": owner, "rule": pair[at][first].view("int64"), "tokens": wide[first], "uses": uses}))
        symbols, width = symbols.copy(), width.copy()
        symbols[at], width[at] = pair[at], wide
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, width, files = symbols[keep], width[keep], files[keep]
    final = np.bincount(files, minlength=n_files) if n_files else np.zeros(0, "int64")
    return final, n_rules, pd.concat(found, ignore_index=True) if found else pd.DataFrame({"file": [], "rule": [], "tokens": [], "uses": []}).astype("int64")


def is_opaque(token: str) -> bool:
    """Whether a long token is a literal without structure: mixed letters and digits, or letters of one case and digits
    whose entropy is nearly that of random hexadecimal or base32 digits in a literal of this length."""
    if len(token) < 40 or "_" in token or not re.search(r"\d", token):
        return False
    if re.search(r"[a-z]", token) and re.search(r"[A-Z]", token):
        return True
    body = token.removeprefix("0x").removeprefix("0X").rstrip("=").lower()
    size = 16 if re.fullmatch(r"[0-9a-f]+", body) else 32
    share = np.array(list(Counter(body).values())) / max(1, len(body))
    random = np.log2(size) - (size - 1) / (2 * np.log(2) * max(1, len(body)))
    return bool(-(share * np.log2(share)).sum() >= RANDOM_SHARE * random)


def comment_blocks(lines: list[str]) -> tuple[int, int, set[int]]:
    """(end of the leading comment block, start of the trailing one, lines inside open comments without a sign of their own)."""
    inner: set[int] = set()
    first, until = 0, ""
    for k, line in enumerate(lines):
        s = line.strip()
        if until:
            inner.add(k)
            until = "" if until in s else until
        elif s and not s.startswith("#!"):
            if not _COMMENT.match(line):
                break
            until = next((c for o, c in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")) if s.startswith(o) and c not in s[len(o) :]), "")
        first = k + 1
    last, until = len(lines), ""
    for k in range(len(lines) - 1, first - 1, -1):
        s = lines[k].strip()
        if until:
            inner.add(k)
            until = "" if until in s else until
        elif s:
            until = next((o for o, c in (("/*", "*/"), ("<!--", "-->")) if s.endswith(c) and o not in s), "")
            if until:
                inner.add(k)
            elif not _COMMENT.match(lines[k]):
                break
        last = k
    return first, last, inner


def header_says(text: str) -> tuple[bool, bool]:
    """(generated, vendored) as the leading and trailing comment blocks say, and comments in the first and last lines."""
    generated = vendored = False
    lines = text.strip().split("\n")
    first, last, inner = comment_blocks(lines)
    head = max(12, first)
    for k in [*range(min(head, len(lines))), *range(max(head, min(last, len(lines) - 4)), len(lines))]:
        m = _COMMENT.match(lines[k])
        if not m and k not in inner:
            continue
        said = (m[1] if m else lines[k]).strip()
        if _SAYS_GENERATED.search(said) and not _NOT_GENERATED.search(said):
            generated = True
        if k < max(6, first) and _SAYS_VENDORED.search(said):
            vendored = True
    return generated, vendored


def file_features(texts: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(features per file, its long rules) of a batch of files."""
    symbols: list[str] = []
    literals: list[str] = []
    lengths, rows = [], []
    for text in texts:
        toks = _TOKEN.findall(text)
        numbers = names = single = opaque = 0
        out, own = [], []
        for t in toks:
            c = t[0]
            if is_opaque(t):
                opaque += len(t)
                own.append(t)
                out.append("#B")
            elif c.isdigit():
                numbers += 1
                own.append(t)
                out.append("#N")
            elif c.isalpha() or c == "_":
                names += 1
                single += len(t) == 1
                out.append(_DIGITS.sub("0", t))
            else:
                out.append(t)
        symbols += out
        literals.append("\n".join(own))
        lengths.append(len(out))
        spaces = text.count(" ") + text.count("\n") + text.count("\t")
        lines = [x for x in text.split("\n") if x.strip()]
        says = header_says(text)
        rows.append((len(text), len(lines), len(out), numbers / max(1, numbers + names), opaque / max(1, len(text) - spaces), sum(map(len, own)) / max(1, len(text) - spaces), spaces / max(1, len(text)), single / max(1, names), *says))
    features = pd.DataFrame(rows, columns=["chars", "lines", "tokens", "number_share", "opaque_share", "literal_share", "space_share", "single_share", "says_generated", "says_vendored"])
    codes, values = pd.factorize(np.array(symbols, dtype=object)) if symbols else (np.zeros(0, "int64"), np.array([]))
    hashes = pd.util.hash_array(np.asarray(values, dtype=object), categorize=False) if len(values) else np.zeros(0, "uint64")
    files = np.repeat(np.arange(len(texts)), lengths)
    final, n_rules, rules = repair(hashes[codes] if len(symbols) else np.zeros(0, "uint64"), files)
    features["grammar"] = (np.r_[final, np.zeros(len(texts) - len(final), "int64")] + 2 * np.r_[n_rules, np.zeros(len(texts) - len(n_rules), "int64")]) / np.maximum(features["tokens"], 1)
    features["literal_ratio"] = incompressibility(literals)
    return features, rules


def incompressibility(literals: list[str]) -> np.ndarray:
    """Size of the Re-Pair grammar of each text's characters beside that of the same characters in a random, fixed order: near 1
    where nothing repeats, 0 for empty texts."""
    coded = [np.frombuffer(x.encode(), np.uint8) for x in literals]
    mixed = [np.random.default_rng(len(x)).permutation(x.copy()) for x in coded]
    files = np.repeat(np.arange(len(coded)), np.array([len(x) for x in coded], "int64"))
    sizes = []
    for sequences in (coded, mixed):
        final, n_rules, _ = repair(_mix(np.concatenate([*sequences, np.zeros(0, np.uint8)]).astype("uint64") + _M1, _M2), files)
        more = np.zeros(len(coded) - len(final), "int64")
        sizes.append(np.r_[final, more] + 2 * np.r_[n_rules, more])
    return sizes[0] / np.maximum(sizes[1], 1)


_FEATURES = "doc_id bigint, chars bigint, lines bigint, tokens bigint, number_share double, opaque_share double, literal_share double, space_share double, single_share double, says_generated boolean, says_vendored boolean, grammar double, literal_ratio double, rules array<bigint>"


def _analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            features, rules = file_features(part["text"].tolist())
            long = rules[rules["tokens"] >= SHARED_TOKENS].groupby("file")["rule"].apply(lambda r: sorted(set(r.tolist())))
            features["rules"] = [long.get(i, []) for i in range(len(part))]
            features.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield features


def vendored_path(path: str) -> F.Column:
    """Whether a path lies in a folder that holds copies of other packages."""
    return F.col(path).rlike("(?i)" + _VENDORED_PATH.pattern)


def classify_code(document_texts: DataFrame, document_rows: DataFrame) -> DataFrame:
    """(doc_id, path, kind, grammar, ...) of every code record; kind is null for hand-written source.

    Kinds, the first that applies: ``generated`` (the grammar is small against the file, its rules being used over and
    over, or its first or last comments say so), ``minified`` (hardly any white space, names of one letter), ``data``
    (much of it numbers and long literals that a grammar of their characters does not make smaller than chance, or that repeat in a small grammar of the whole file), ``vendored`` (a folder or banner of another package,
    or rules most of which other repositories have too). The path and the repository (collection) are those of the
    newest row of the document; records without one are judged by their text. Null texts and other extractors are left
    out; of repeated rows of a doc_id one counts.
    """
    code = document_texts.where("extractor_key = 'code' and text is not null and doc_id is not null").select("doc_id", "text")
    features = materialize(code.mapInPandas(_analyse, _FEATURES), "code")
    features = features.dropDuplicates(["doc_id"])
    newest = document_rows.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("path", "collection_id"), F.struct("recorded_at", "row_id")).alias("r")).select("doc_id", "r.*")
    placed = features.join(newest, "doc_id", "left")
    each = placed.select("doc_id", "collection_id", F.explode("rules").alias("rule"))
    spread = each.where("collection_id is not null").select("rule", "collection_id").distinct().groupBy("rule").agg(F.count("*").alias("k")).where(F.col("k") >= SHARED_REPOSITORIES)
    shared = each.join(spread, "rule", "left").groupBy("doc_id").agg((F.count("k") / F.count("*")).alias("shared_share"), F.count("*").alias("long_rules"))
    full = placed.drop("rules").join(shared, "doc_id", "left")
    generated = ((F.col("grammar") < UNIFORM_RATIO) & (F.col("tokens") >= UNIFORM_TOKENS)) | F.col("says_generated")
    minified = (F.col("space_share") < MINIFIED_SPACE) & (F.col("single_share") >= MINIFIED_NAMES)
    uniform = (F.col("grammar") < UNIFORM_RATIO) & (F.col("tokens") >= UNIFORM_TOKENS)
    random = F.col("literal_ratio") >= DATA_RANDOM
    data = (F.col("literal_share") >= DATA_LITERALS) & (random | uniform)  # a table of repeated numbers has a small grammar instead
    shared = F.coalesce((F.col("shared_share") >= SHARED_SHARE) & (F.col("long_rules") >= SHARED_RULES), F.lit(False))
    copied = F.coalesce(vendored_path("path"), F.lit(False)) | F.col("says_vendored") | shared
    kind = F.when(data, "data").when(minified, "minified").when(generated, "generated").when(copied, "vendored")
    reason = (
        F.when(data & random, "incompressible literals").when(data, "rule reuse").when(minified, "spacing and names").when(uniform, "rule reuse").when(F.col("says_generated"), "banner")
        .when(shared, "shared rules").when(F.coalesce(vendored_path("path"), F.lit(False)), "folder").when(F.col("says_vendored"), "banner")
    )
    return full.select("doc_id", "path", kind.alias("kind"), reason.alias("reason"), "grammar", "literal_share", "literal_ratio", "number_share", "opaque_share", "space_share", "single_share", "says_generated", "says_vendored", "shared_share", "long_rules", "tokens")
