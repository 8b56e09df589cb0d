"""Text and identity expressions, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    """A column from its name or itself."""
    return F.col(c) if isinstance(c, str) else c


def analyzed_terms(text: str | Column) -> Column:
    """Terms of a field: lower-cased runs of letters and digits of fewer than 40 bytes; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < 40))


def query_terms(text: str | Column) -> Column:
    """Distinct terms of a query."""
    return F.array_distinct(analyzed_terms(text))


def whitespace_tokens(text: str | Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda t: t != "")


def normalized_query(text: str | Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def short_docid(hash_: str | Column) -> Column:
    """'#' and six hex digits of a content hash."""
    return F.concat(F.lit("#"), F.substring(col(hash_), 1, 6))


def normalized_docid(docid: str | Column) -> Column:
    """A docid without its '#'."""
    return F.regexp_replace(F.trim(col(docid)), "^#+", "")


def semantic_title(title: str | Column, source: str | Column) -> Column:
    """The title where it was extracted and is not blank, else null."""
    return F.when((col(source) == "extracted") & (F.trim(col(title)) != ""), F.trim(col(title)))


def file_title(path: str | Column) -> Column:
    """File name of a path."""
    return F.element_at(F.split(col(path), "/"), -1)


def retrieval_body(prefix: str | Column, text: str | Column) -> Column:
    """Retrieval prefix and text on lines of their own; a blank prefix is none."""
    has = F.coalesce(F.trim(col(prefix)) != "", F.lit(False))
    return F.when(has, F.concat(col(prefix), F.lit("\n"), F.coalesce(col(text), F.lit("")))).otherwise(F.coalesce(col(text), F.lit("")))


def contextual_text(body: Column, title: Column, heading: Column, enabled: bool = True) -> Column:
    """Body after 'title:' and 'heading:' lines for those that are not blank, and an empty line."""
    if not enabled:
        return body
    lines = F.concat_ws("\n", F.when(F.trim(title) != "", F.concat(F.lit("title: "), F.trim(title))), F.when(F.trim(heading) != "", F.concat(F.lit("heading: "), F.trim(heading))))
    return F.when(lines != "", F.concat(lines, F.lit("\n\n"), body)).otherwise(body)


def byte_slice(text: str | Column, offset: str | Column, length: str | Column) -> Column:
    """Text of a byte range of the UTF-8 form; null where the range is no valid text or lies outside."""
    raw = F.encode(col(text), "UTF-8")
    part = raw.substr((col(offset) + 1).cast("int"), col(length).cast("int"))
    inside = (col(offset) >= 0) & (col(length) >= 0) & (col(offset) + col(length) <= F.octet_length(raw))
    return F.when(inside & F.is_valid_utf8(part.cast("string")), part.cast("string"))


def is_locator_path(locator: str | Column) -> Column:
    """Whether a locator is a path (else a docid)."""
    return F.contains(col(locator), F.lit("/"))


def path_has_prefix(path: str | Column, prefix: str) -> Column:
    """Whether a path is, or lies below, a normalised prefix; an empty prefix holds for all."""
    return F.lit(True) if not prefix else (col(path) == prefix) | col(path).startswith(prefix + "/")


def normalize_prefix(prefix: str) -> str:
    """A relative listing prefix without empty and '.' segments; absolute ones and '..' are errors."""
    clean = prefix.replace("\\", "/").strip()
    if clean.startswith("/") or ".." in clean.split("/"):
        raise ValueError(f"prefix must be relative and may not contain '..': {prefix}")
    return "/".join(s for s in clean.split("/") if s not in ("", "."))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two arrays; 0 for different lengths or a zero norm."""
    x, y = F.transform(col(a), lambda v: v.cast("double")), F.transform(col(b), lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v))
    ok = (F.size(x) == F.size(y)) & (norm(x) > 0) & (norm(y) > 0)
    return F.when(ok, dot / (norm(x) * norm(y))).otherwise(F.lit(0.0))


def distance_score(distance: str | Column) -> Column:
    """Score of a distance: 1 / (1 + distance), distances below 0 as 0."""
    return 1.0 / (1.0 + F.greatest(col(distance), F.lit(0.0)))
