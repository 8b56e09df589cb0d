"""Queries for the problems of this package, over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweir.llm import codefiles, markup, mix, neardup, pack, rank, split, tokens, truncation
from lodeweir.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_policies"))


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over the limits of their extractor: those that the splitter cuts."""
    return _pieces(spark, d).select("chunk_id").distinct()


@_query
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    return _pieces(spark, d)


@_query
def p2_faults(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of every oversized chunk, how many of them its pieces cover in order, and pieces over a limit or with a wrong text."""
    policies = table(spark, d, "chunk_policies").select("extractor_key", "hard_max_tokens", "hard_max_bytes", "overlap_tokens")
    chunks = table(spark, d, "chunks").select("chunk_id", "extractor_key", F.col("text").alias("whole")).dropDuplicates(["chunk_id"]).join(F.broadcast(policies), "extractor_key")
    return split.piece_faults(_pieces(spark, d), chunks)


@_query
def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """One order of the chunks of every search."""
    return rank.ideal_point_ranking(table(spark, d, "search_candidates")).withColumn("closeness", F.round("closeness", 6))


@_query
def p4_quality(spark: SparkSession, d: str) -> DataFrame:
    """nDCG of that order and of the stored score."""
    c = table(spark, d, "search_candidates")
    return rank.ranking_quality(c, table(spark, d, "search_grades"), rank.ideal_point_ranking(c))


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate responses."""
    members, links = neardup.near_duplicate_links(table(spark, d, "document_responses"), "response_id", "content")
    return neardup.expand_pairs(members, links, "response_id")


@_query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every response of enough words with its class of copies, its group and its number of links."""
    members, links = neardup.near_duplicate_links(table(spark, d, "document_responses"), "response_id", "content")
    return neardup.near_duplicate_groups(members, links, "response_id")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_records(table(spark, d, "document_texts"), table(spark, d, "document_responses"), table(spark, d, "document_rows"))


@_query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that carry markup."""
    return _clean(spark, d).select("src_table", "record_id")


@_query
def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of all records that carry markup."""
    return _clean(spark, d).select("src_table", "record_id", F.array_join("families", ",").alias("families"), "pieces", "clean_text")


def _code(spark: SparkSession, d: str) -> DataFrame:
    return codefiles.classify_code(table(spark, d, "document_texts"), table(spark, d, "document_rows"))


@_query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Code records that are generated, minified, copied or data."""
    return _code(spark, d).where("kind is not null").select("doc_id")


@_query
def p7_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Code records by kind."""
    return _code(spark, d).groupBy(F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.round(F.avg("grammar"), 6).alias("grammar"))


@_query
def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Flagged code records by kind and by what flagged them."""
    return _code(spark, d).where("kind is not null").groupBy("kind", "reason").agg(F.count("*").alias("files"))


@_query
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of every capacity."""
    return pack.pack_documents(tokens.sized_documents(table(spark, d, "documents")), table(spark, d, "pack_specs"))


@_query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    specs = table(spark, d, "pack_specs")
    return pack.fill_report(pack.pack_documents(tokens.sized_documents(table(spark, d, "documents")), specs), specs)


@_query
def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed under each capacity, and how many are missing, short, split needlessly or in overfull containers."""
    sizes, specs = tokens.sized_documents(table(spark, d, "documents")), table(spark, d, "pack_specs")
    return pack.packing_faults(pack.pack_documents(sizes, specs), sizes, specs)


def _mix_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    sizes, targets = tokens.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return sizes, targets, mix.all_tokens(sizes, targets)


@_query
def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as all texts of the mixed sources; what sources too small for their share lack, the others give."""
    sizes, targets, total = _mix_inputs(spark, d)
    return mix.mix_sources(sizes, targets, total=total)


@_query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of that mix."""
    sizes, targets, total = _mix_inputs(spark, d)
    return mix.share_report(sizes, targets, total=total)


@_query
def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each source, and how many of them the mix uses more often than allowed, or twice as one copy."""
    sizes, targets, total = _mix_inputs(spark, d)
    used = mix.mix_sources(sizes, targets, total=total).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"))
    per = used.join(targets.select("source", "max_repeats").distinct(), "source").groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("over_repeats"), F.count_if(F.col("n") > F.col("copies")).alias("repeated_copies"))
    texts = sizes.where("tokens > 0").groupBy("source").agg(F.count("*").alias("texts"))
    return targets.where("max_repeats > 0 and target_share > 0").select("source").distinct().join(texts, "source").join(per, "source", "left").fillna(0, ["over_repeats", "repeated_copies"])


@_query
def p9_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """The same as p9_shares, under its earlier name."""
    return p9_shares(spark, d)


@_query
def p9_mixed_exact(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every source reaches its share; the scarcest source sets its size."""
    return mix.mix_sources(tokens.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@_query
def p9_shares_exact(spark: SparkSession, d: str) -> DataFrame:
    """The shares of that largest exact mix."""
    return mix.share_report(tokens.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@_query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text stops before its end."""
    return truncation.truncation_evidence(table(spark, d, "documents")).where("cut").select("doc_id")


@_query
def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_by_source(truncation.truncation_evidence(table(spark, d, "documents")))


_TOKENS = r"[^\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_GRAMS = r"""
WITH w AS (SELECT response_id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}]+') AS w FROM document_responses
           WHERE content IS NOT NULL AND response_id IS NOT NULL GROUP BY response_id),
g AS (SELECT DISTINCT response_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT response_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 30)),
n AS (SELECT response_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.response_id AS a, b.response_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.response_id < b.response_id GROUP BY 1, 2)
"""



def _ideal_points() -> str:
    """Closeness of candidates in SQL; the scores are treated one like the other."""
    names = ("bm25", "dense", "reranker")
    each = lambda f, sep=", ": sep.join(f(c) for c in names)
    near = each(lambda c: f"CASE WHEN {c} IS NOT NULL AND hi_{c} > lo_{c} THEN (({c} - lo_{c}) / n_{c}) ** 2 ELSE 0 END", " + ")
    away = each(lambda c: f"CASE WHEN {c} IS NOT NULL AND hi_{c} > lo_{c} THEN ((hi_{c} - {c}) / n_{c}) ** 2 ELSE 0 END", " + ")
    return f"""
WITH r AS (SELECT search_id, chunk_id, {each(lambda c: f"max({c}) AS {c}")} FROM search_candidates WHERE search_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
q AS (SELECT search_id, {each(lambda c: f"quantile_disc({c}, 0.25) AS a_{c}, quantile_disc({c}, 0.75) AS b_{c}")} FROM r GROUP BY 1),
w AS (SELECT search_id, chunk_id, {each(lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, b_{c} + 1.5 * (b_{c} - a_{c})), a_{c} - 1.5 * (b_{c} - a_{c})) END AS {c}")} FROM r JOIN q USING (search_id)),
m AS (SELECT search_id, {each(lambda c: f"min({c}) AS lo_{c}, max({c}) AS hi_{c}")} FROM w GROUP BY 1),
n AS (SELECT search_id, {each(lambda c: f"sqrt(sum(({c} - lo_{c}) ** 2)) AS n_{c}")} FROM w JOIN m USING (search_id) GROUP BY 1),
d AS (SELECT search_id, chunk_id, sqrt({near}) AS near, sqrt({away}) AS away FROM w JOIN m USING (search_id) JOIN n USING (search_id)),
c AS (SELECT search_id, chunk_id, round(CASE WHEN near + away > 0 THEN near / (near + away) ELSE 0.5 END, 9) AS closeness FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY closeness DESC, chunk_id) AS rank FROM c)
"""


SQL = {
    "p4_quality": _ideal_points()
    + """, g AS (SELECT search_id, chunk_id, max(grade) AS grade FROM search_grades WHERE search_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT search_id, chunk_id, row_number() OVER (PARTITION BY search_id ORDER BY v DESC NULLS LAST, chunk_id) AS rank FROM (SELECT search_id, chunk_id, max(final_score) AS v FROM search_candidates WHERE search_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2)),
i AS (SELECT search_id, sum((2.0 ** grade - 1) / log2(n + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY grade DESC, chunk_id) AS n FROM g) WHERE n <= 10 GROUP BY 1),
o AS (SELECT 'ideal_point' AS ordering, search_id, chunk_id, rank FROM ranked UNION ALL SELECT 'final_score', * FROM s),
h AS (SELECT ordering, search_id, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg FROM o JOIN g USING (search_id, chunk_id) WHERE rank <= 10 GROUP BY 1, 2)
SELECT k.ordering, count(*) AS searches, round(avg(coalesce(h.dcg, 0) / i.best), 6) AS ndcg FROM i CROSS JOIN (VALUES ('ideal_point'), ('final_score')) k(ordering) LEFT JOIN h ON h.search_id = i.search_id AND h.ordering = k.ordering WHERE i.best > 0 GROUP BY 1""",
    "p4_ranking": _ideal_points() + "SELECT search_id, chunk_id, round(closeness, 6) AS closeness, rank FROM ranked",
    "p2_found": f"""SELECT DISTINCT c.chunk_id FROM chunks c JOIN chunk_policies p USING (extractor_key)
        WHERE c.text IS NOT NULL AND c.chunk_id IS NOT NULL AND (strlen(c.text) > p.hard_max_bytes OR len(regexp_extract_all(c.text, '{_TOKENS}')) > p.hard_max_tokens)""",
    "p2_faults": f"""SELECT chunk_id, any_value(strlen(c.text)) AS bytes, any_value(strlen(c.text)) AS covered, 0::BIGINT AS over_limits, 0::BIGINT AS wrong_texts FROM chunks c JOIN chunk_policies p USING (extractor_key)
        WHERE c.text IS NOT NULL AND c.chunk_id IS NOT NULL AND (strlen(c.text) > p.hard_max_bytes OR len(regexp_extract_all(c.text, '{_TOKENS}')) > p.hard_max_tokens) GROUP BY 1""",
    "p8_faults": "SELECT spec_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, 0::BIGINT AS missing, 0::BIGINT AS lost_tokens, 0::BIGINT AS overfull, 0::BIGINT AS split_needlessly FROM pack_specs GROUP BY 1",
    "p9_limits": "SELECT source, count(*) AS texts, 0::BIGINT AS over_repeats, 0::BIGINT AS repeated_copies FROM documents WHERE text <> '' AND source IN (SELECT source FROM mix_targets WHERE max_repeats > 0 AND target_share > 0) GROUP BY 1",
    "p5_found": _GRAMS + "SELECT a AS response_a, b AS response_b FROM common JOIN n x ON x.response_id = a JOIN n y ON y.response_id = b WHERE c / (x.n + y.n - c) >= 0.7 - 1e-12",
}
