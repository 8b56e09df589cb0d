"""Batch retrieval: BM25, exact nearest neighbours, fusion, deep variants, reranking. Every frame carries a query id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweir.functions.text import analyzed_terms, contextual_text, distance_score, query_terms, retrieval_body
from lodeweir.session import broadcast_if_small, materialize

#: BM25 parameters and field boosts, fusion and rerank constants.
K1, B = 1.2, 0.75
BOOSTS = {"title": 2.0, "heading": 1.5, "body": 1.0, "filepath": 0.5}
RRF_K, LINEAR_WEIGHTS, DBSF_WEIGHTS, DBSF_SIGMAS = 60, (0.7, 0.3), (1.0, 0.4), 3.0
NEAR_DUPLICATE_VARIANT, MIN_CANDIDATES, RERANK_MIN, RERANK_MAX = 0.98, 40, 20, 30
TINY = 1.1920929e-7
#: Query terms are broadcast up to so many rows (checked by a count); query vectors of one pass over all vectors.
SMALL_QUERIES, QUERY_BLOCK = 200_000, 10_000
#: Similarities in memory at once.
_PRODUCTS = 4_000_000


def with_fields(index_chunks: DataFrame, contextual: bool = True) -> DataFrame:
    """Index rows with the four searched fields; the body carries the retrieval prefix and, if asked, context lines."""
    title, heading = F.coalesce("doc_title", F.lit("")), F.coalesce("heading", F.lit(""))
    body = contextual_text(retrieval_body("retrieval_prefix", "text"), title, heading, contextual)
    named = "collection_name" if "collection_name" in index_chunks.columns else F.lit(None).cast("string").alias("collection_name")
    return index_chunks.select("space_name", "collection_id", named, "doc_id", "chunk_id", "active", F.coalesce("filepath", F.lit("")).alias("filepath"), title.alias("title"), heading.alias("heading"), body.alias("body"))


_FACTS = ("space_name", "collection_name", "doc_id", "chunk_id", "active")


@dataclass
class TextIndex:
    """Inverted index: postings, lengths and statistics per space and field, and the scored postings that searches read.

    ``scored`` has a row per space, term and chunk with the weight of the term in each field before boosts, and what
    scopes ask for (collection, active), so that a search is one join with its terms.
    """

    lengths: DataFrame
    postings: DataFrame
    stats: DataFrame
    scored: DataFrame

    @classmethod
    def build(cls, entries: DataFrame) -> TextIndex:
        """Index of entries with the searched fields; soft-deleted documents count, as their postings stay.

        Texts are analysed once: the terms are written to the shared folder, and lengths, postings and statistics read them.
        """
        return cls.of_terms(materialize(analyzed_entries(entries), "terms"))

    @classmethod
    def of_terms(cls, each: DataFrame) -> TextIndex:
        """Index of analysed entries."""
        size = F.size("terms").cast("bigint").alias("len")
        lengths = each.select(*_FACTS, "field", size)
        postings = each.select(*_FACTS, "field", size, F.explode("terms").alias("term")).groupBy(*_FACTS, "field", "len", "term").agg(F.count("*").alias("tf"))
        return cls.of_postings(lengths, postings)

    @classmethod
    def of_postings(cls, lengths: DataFrame, postings: DataFrame) -> TextIndex:
        """Index with statistics and weights of the given postings."""
        stats = lengths.groupBy("space_name", "field").agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))
        df = postings.groupBy("space_name", "field", "term").agg(F.count("*").alias("df"))
        norm = F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len"))
        w = idf(F.col("n_chunks"), F.col("df")) * F.col("tf") * (K1 + 1.0) / norm
        each = postings.join(df, ["space_name", "field", "term"]).join(broadcast_if_small(stats, SMALL_QUERIES), ["space_name", "field"]).withColumn("w", w)
        scored = each.groupBy("term", *_FACTS).agg(*[F.sum(F.when(F.col("field") == f, F.col("w")).otherwise(0.0)).alias(f"w_{f}") for f in BOOSTS])
        return cls(lengths, postings, stats, scored)

    def write(self, path: str) -> None:
        """Lay the index down as tables. Scored postings are split by ranges of terms and chunks, so that a common term is no
        single task and a file has few terms; statistics are written last and tell that the index is whole."""
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        TextIndex.of_postings(spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/postings")).scored.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/scored")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TextIndex | None:
        """The index at ``path``, None where there is no whole one."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("lengths", "postings", "stats", "scored")])

    def without(self, keys: DataFrame, on: str = "chunk_id") -> TextIndex:
        """The index after deleting chunks (chunk_id) or documents (doc_id)."""
        k = keys.select(on).distinct()
        return TextIndex.of_postings(self.lengths.join(k, on, "left_anti"), self.postings.join(k, on, "left_anti"))


def analyzed_entries(entries: DataFrame) -> DataFrame:
    """Entries as one row per field with its terms."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), analyzed_terms(f).alias("terms")) for f in BOOSTS])
    facts = [F.col(c) if c in entries.columns else F.lit(None).cast("string").alias(c) for c in _FACTS]
    return entries.select(*facts, F.explode(fields).alias("x")).select(*_FACTS, "x.field", "x.terms")


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def term_statistics(index: TextIndex) -> DataFrame:
    """(space_name, field, term, df, idf)."""
    df = index.postings.groupBy("space_name", "field", "term").agg(F.count("*").alias("df"))
    return df.join(index.stats, ["space_name", "field"]).select("space_name", "field", "term", "df", idf(F.col("n_chunks"), F.col("df")).alias("idf"))


def in_scope(space: str = "q_space", collections: str = "q_collections") -> Column:
    """Whether an index row (space_name, collection_name, active) lies in a query's optional space and collections."""
    no_space, no_collection = F.col(space).isNull(), F.coalesce(F.size(collections), F.lit(0)) <= 0
    return F.col("active") & (no_space | (F.col(space) == F.col("space_name"))) & (no_collection | F.array_contains(collections, F.col("collection_name")))


def _asked(queries: DataFrame) -> list[Column]:
    return [(F.col(c) if c in queries.columns else F.lit(None)).cast(t).alias(n) for c, t, n in (("space_name", "string", "q_space"), ("collections", "array<string>", "q_collections"))]


def bm25_scores(queries: DataFrame, index: TextIndex, scope: DataFrame | None = None, boosts: dict[str, float] | None = None, scoped: bool = False) -> DataFrame:
    """(qid, space_name, chunk_id, score): sum of boosted BM25 over (field, distinct query term), literal OR semantics.

    Document frequencies and lengths are those of whole spaces: neither ``scope`` (qid, chunk_id) nor ``scoped``, which holds
    each query to active chunks of its own space_name and collections, changes a score. Such scopes are tested as columns
    of the postings; no pairs of queries and chunks are made. Queries without terms have no results.
    """
    boosts = boosts or BOOSTS
    unknown = set(boosts) - set(BOOSTS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    terms = broadcast_if_small(queries.select("qid", F.explode(query_terms("text")).alias("term"), *(_asked(queries) if scoped else [])), SMALL_QUERIES)
    hits = index.scored.join(terms, "term")
    if scoped:
        hits = hits.where(in_scope())
    weight = sum((F.lit(float(b)) * F.col(f"w_{f}") for f, b in boosts.items()), F.lit(0.0))
    touched = F.lit(False)
    for f in boosts:
        touched = touched | (F.col(f"w_{f}") > 0)
    scores = hits.where(touched).groupBy("qid", "space_name", "chunk_id").agg(F.sum(weight).alias("score"))
    return scores if scope is None else scores.join(scope, ["qid", "chunk_id"], "left_semi")


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; the filter on the rank lets partial limits run before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


def keyword_results(scores: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    """(qid, rank, chunk_id, space_name, raw, score): per-space top lists merged by raw score, divided by the query's greatest."""
    per_space = top_k(scores, limit, ["qid", "space_name"], [F.desc("score"), F.asc("chunk_id")]).drop("rank")
    merged = top_k(per_space, limit, ["qid"], [F.desc("score"), F.asc("chunk_id")])
    out = merged.withColumn("raw", F.col("score")).withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("qid")))
    return out.where(F.col("score") >= min_score).select("qid", "rank", "chunk_id", "space_name", "raw", "score")


def _matrix(vectors: pd.Series, dimensions: int | None) -> np.ndarray:
    """Unit vectors as rows; null entries are 0 and zero vectors stay zero. Another dimension is an error."""
    sizes = set(vectors.map(len))
    if len(sizes | ({dimensions} if dimensions is not None else set())) > 1:
        raise ValueError(f"vectors have dimensions {sorted(sizes)}, queries {dimensions}")
    m = np.nan_to_num(np.array([np.asarray(v, dtype="float64") for v in vectors]))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _best(similarity: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``limit`` by similarity (ties within 1e-9 by id) of one query."""
    rounded = np.round(similarity, 9)
    if len(ids) > limit:
        kept = np.flatnonzero(rounded >= np.partition(rounded, len(ids) - limit)[len(ids) - limit])
        similarity, rounded, ids = similarity[kept], rounded[kept], ids[kept]
    order = np.lexsort((ids, -rounded))[:limit]
    return similarity[order], ids[order]


def _products(qids: np.ndarray, q: np.ndarray, spaces: list, collections: list, limit: int, scoped: bool):
    """Best neighbours of all queries within a task, by blocked matrix products."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, "int64")) for _ in qids]
        step = max(1, _PRODUCTS // max(1, len(qids)))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                ids, product = part["chunk_id"].to_numpy(), q @ _matrix(part["vector"], q.shape[1]).T
                allowed = None
                if scoped:
                    homes: dict[tuple[str, str], int] = {}
                    home = [homes.setdefault(h, len(homes)) for h in zip(part["space_name"], part["collection_name"], strict=True)]
                    fits = np.array([[(s is None or s == a) and (not c or b in c) for a, b in homes] for s, c in zip(spaces, collections, strict=True)])
                    allowed = fits[:, home] & part["active"].to_numpy().astype(bool)
                for k in range(len(qids)):
                    sims, own = (product[k], ids) if allowed is None else (product[k][allowed[k]], ids[allowed[k]])
                    if len(best[k][0]) == limit:
                        more = sims >= best[k][0][-1] - 1e-9
                        sims, own = sims[more], own[more]
                    if len(own):
                        best[k] = _best(np.r_[best[k][0], sims], np.r_[best[k][1], own], limit)
        for k in range(0, len(qids), 1000):
            rows = best[k : k + 1000]
            yield pd.DataFrame({"qid": np.repeat(qids[k : k + 1000], [len(r[1]) for r in rows]), "chunk_id": np.concatenate([r[1] for r in rows]).astype("int64"), "similarity": np.concatenate([r[0] for r in rows])})

    return run


def knn_results(queries: DataFrame, vectors: DataFrame, limit: int, allowed: DataFrame | None = None, scoped: bool = False) -> DataFrame:
    """(qid, rank, chunk_id, similarity, score): exact nearest neighbours of query vectors (qid, vector) among (chunk_id, vector).

    Cosine similarity, 0 for zero vectors; vectors of another dimension are an error. Ties within 1e-9 go to the lower
    chunk_id. ``allowed`` (chunk_id) filters before the top k; ``scoped`` holds each query to active vectors of its own
    space_name and collections, which are columns of both sides. The stated set of queries is sent in blocks of
    QUERY_BLOCK, one pass over the vectors each; a task keeps the best of its vectors and only these are shuffled.
    """
    pool = vectors if allowed is None else vectors.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    asked = queries.select("qid", "vector", *_asked(queries)).where("vector is not null")
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    share, found = queries.sparkSession.sparkContext.broadcast, None
    for k in range(max(1, blocks)):
        rows = (asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else asked).orderBy("qid").toPandas()
        if not len(rows):
            continue
        held = share((rows["qid"].to_numpy(), _matrix(rows["vector"], None), [x or None for x in rows["q_space"]], [None if x is None or not len(x) else set(x) for x in rows["q_collections"]]))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            return _products(*held.value, limit, scoped)(batches)

        part = pool.where("vector is not null").select("chunk_id", "vector", *(("space_name", "collection_name", "active") if scoped else ())).mapInPandas(run, "qid bigint, chunk_id bigint, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "qid bigint, chunk_id bigint, similarity double")
    best = top_k(found, limit, ["qid"], [F.desc(F.round("similarity", 9)), F.asc("chunk_id")])
    return best.select("qid", "rank", "chunk_id", "similarity", distance_score(1.0 - F.col("similarity")).alias("score"))


def branch_lists(candidates: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Keyword and dense lists (qid, chunk_id, score, rank) of candidates with bm25 and dense, cut at ``limit``."""
    once = candidates.where("search_id is not null and chunk_id is not null").groupBy(F.col("search_id").alias("qid"), "chunk_id").agg(F.max("bm25").alias("bm25"), F.max("dense").alias("dense"))
    lists = []
    for c in ("bm25", "dense"):
        branch = once.where(F.col(c).isNotNull() & ~F.isnan(c)).select("qid", "chunk_id", F.col(c).alias("score"))
        lists.append(top_k(branch, limit, ["qid"], [F.desc("score"), F.asc("chunk_id")]))
    return lists[0], lists[1]


def _joined(keyword: DataFrame, dense: DataFrame) -> DataFrame:
    k = keyword.select("qid", "chunk_id", F.col("score").alias("bm25"), F.col("rank").alias("k_rank"))
    d = dense.select("qid", "chunk_id", F.col("score").alias("dense"), F.col("rank").alias("d_rank"))
    return k.join(d, ["qid", "chunk_id"], "full_outer")


def _single(joined: DataFrame) -> tuple[Column, Column]:
    """Whether a query has only a dense list, and whether it has only a keyword list."""
    w = Window.partitionBy("qid")
    return F.count("bm25").over(w) == 0, F.count("dense").over(w) == 0


def _finish(df: DataFrame, limit: int, min_score: float) -> DataFrame:
    w = Window.partitionBy("qid")
    scored = df.withColumn("score", F.when(F.max("score").over(w) > 0, F.col("score") / F.max("score").over(w)).otherwise(F.lit(0.0))).where(F.col("score") >= min_score)
    return top_k(scored, limit, ["qid"], [F.desc("score"), F.asc("chunk_id")]).select("qid", "rank", "chunk_id", "score", "bm25", "dense")


def fuse_rrf(keyword: DataFrame, dense: DataFrame, limit: int = 10, k: int = RRF_K, min_score: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of two lists; a query with one list keeps it unfused."""
    j = _joined(keyword, dense)
    only_dense, only_keyword = _single(j)
    fused = F.coalesce(1.0 / (k + F.col("k_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("d_rank")), F.lit(0.0))
    return _finish(j.withColumn("score", F.when(only_dense, F.col("dense")).when(only_keyword, F.col("bm25")).otherwise(fused)), limit, min_score)


def fuse_linear(keyword: DataFrame, dense: DataFrame, limit: int = 10, weights: tuple[float, float] = LINEAR_WEIGHTS, min_score: float = 0.0) -> DataFrame:
    """Weighted sum of the lists' scores, each divided by its greatest; weights are (dense, keyword)."""
    j = _joined(keyword, dense)
    w = Window.partitionBy("qid")
    only_dense, only_keyword = _single(j)
    by_max = lambda c: F.coalesce(F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(F.lit(0.0)), F.lit(0.0))
    fused = weights[0] * by_max("dense") + weights[1] * by_max("bm25")
    return _finish(j.withColumn("score", F.when(only_dense, F.col("dense")).when(only_keyword, F.col("bm25")).otherwise(fused)), limit, min_score)


def fuse_dbsf(keyword: DataFrame, dense: DataFrame, limit: int = 10, weights: tuple[float, float] = DBSF_WEIGHTS, sigmas: float = DBSF_SIGMAS, min_score: float = 0.0) -> DataFrame:
    """Distribution-based fusion: scores placed between mean -/+ ``sigmas`` deviations of their list and clamped to 0..1;
    a list without spread is divided by its greatest. Statistics are those of the cut lists."""
    j = _joined(keyword, dense)
    w = Window.partitionBy("qid")
    only_dense, only_keyword = _single(j)

    def placed(c: str) -> Column:
        mean, dev, most = F.avg(c).over(w), F.stddev_pop(c).over(w), F.max(c).over(w)
        spread = F.least(F.greatest((F.col(c) - (mean - sigmas * dev)) / (2 * sigmas * dev), F.lit(0.0)), F.lit(1.0))
        flat = F.when(most > 0, F.col(c) / most).otherwise(F.lit(0.0))
        return F.when(F.col(c).isNull(), 0.0).when(dev > TINY, spread).otherwise(flat)

    fused = weights[0] * placed("dense") + weights[1] * placed("bm25")
    return _finish(j.withColumn("score", F.when(only_dense, F.col("dense")).when(only_keyword, F.col("bm25")).otherwise(fused)), limit, min_score)


def select_variants(vectors: list[list[float]], most: int = 2) -> list[int]:
    """Indexes of query variants to run: 0 and up to ``most`` others by similarity to it, near-duplicates of chosen ones last.

    Works on the few variants of one query; see UDFs in plans.engine for batches.
    """

    def cos(a: list[float], b: list[float]) -> float:
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if len(a) == len(b) and na and nb else 0.0

    others = sorted(range(1, len(vectors)), key=lambda i: (-cos(vectors[0], vectors[i]), i))
    fresh: list[int] = []
    for i in others:
        if len(fresh) < most and all(cos(vectors[i], vectors[j]) < NEAR_DUPLICATE_VARIANT for j in fresh):
            fresh.append(i)
    rest = [i for i in others if i not in fresh]
    return [0, *(fresh + rest)[:most]]


def aggregate_variants(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, chunk_id, score, bm25, dense, original_rank): ranked lists of a query's variants (qid, variant, rank, chunk_id, bm25, dense) by RRF."""
    return ranked.groupBy("qid", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.max("bm25").alias("bm25"), F.max("dense").alias("dense"), F.min(F.when(F.col("variant") == 0, F.col("rank"))).alias("original_rank")
    )


def finalize_variants(aggregated: DataFrame, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """The best ``limit`` of each query, half of them (rounded up) reserved for the first of the original query's own list."""
    w = Window.partitionBy("qid")
    df = aggregated.withColumn("score", F.col("score") / F.max("score").over(w)).where(F.col("score") >= min_score)
    place = F.when(F.col("original_rank").isNotNull(), F.row_number().over(w.orderBy(F.asc_nulls_last("original_rank"), F.desc("score"), F.asc("chunk_id"))))
    df = df.withColumn("protected", F.coalesce(place <= -(-limit // 2), F.lit(False)))
    df = top_k(df, limit, ["qid"], [F.desc("protected"), F.desc("score"), F.asc("chunk_id")], "_pick").drop("_pick")
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.asc("chunk_id"))).cast("bigint")).select("qid", "rank", "chunk_id", "score", "original_rank", "protected")


def rerank_pool_size(candidates: int, limit: int, least: int = RERANK_MIN, most: int = RERANK_MAX) -> int:
    """Documents to rerank."""
    return min(candidates, max(least, min(limit, most)))


def rerank_representatives(candidates: DataFrame, max_docs: int = RERANK_MAX, protected: int = 0) -> DataFrame:
    """(qid, pick, doc_id, chunk_id): the best chunk of each of the first documents, documents of the original list's
    first ``protected`` ranks before all others. ``candidates`` have (qid, position, doc_id, chunk_id, original_rank)."""
    w = Window.partitionBy("qid")
    per_doc = Window.partitionBy("qid", "doc_id")
    first = candidates.withColumn("_r", F.row_number().over(per_doc.orderBy("position"))).withColumn("_o", F.row_number().over(per_doc.orderBy(F.asc_nulls_last("original_rank"), F.asc("position"))))
    best = first.groupBy("qid", "doc_id").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("position", "chunk_id"))).alias("p"), F.max(F.when((F.col("_o") == 1) & F.col("original_rank").isNotNull(), F.struct("original_rank", "position", "chunk_id"))).alias("o")
    )
    best = best.withColumn("_po", F.row_number().over(w.orderBy(F.asc_nulls_last("o.original_rank"), F.asc_nulls_last("o.position"))))
    kept = F.col("o").isNotNull() & (F.col("_po") <= min(protected, max_docs))
    best = best.withColumn("_kept", kept).withColumn("pick", F.row_number().over(w.orderBy(F.desc("_kept"), F.when(F.col("_kept"), F.col("_po")).otherwise(F.col("p.position")))).cast("bigint"))
    # a cap that the protected documents already fill admits one document more
    cap = F.when(F.count_if("_kept").over(w) >= max_docs, max_docs + 1).otherwise(max_docs)
    return best.withColumn("_cap", cap).where(F.col("pick") <= F.col("_cap")).select("qid", "pick", "doc_id", F.when(F.col("_kept"), F.col("o.chunk_id")).otherwise(F.col("p.chunk_id")).alias("chunk_id"))


def apply_rerank(candidates: DataFrame, document_scores: DataFrame) -> DataFrame:
    """(qid, doc_id, chunk_id, position, reranker, final_score, rank): documents in reranker order with prior 1/log2(rank + 1),
    chunks scaled by their fusion score in the document; what was not reranked follows below, in its old order.

    ``candidates`` have (qid, position, doc_id, chunk_id, fusion), ``document_scores`` (qid, doc_id, reranker).
    """
    w = Window.partitionBy("qid")
    doc = Window.partitionBy("qid", "doc_id")
    df = candidates.join(document_scores, ["qid", "doc_id"], "left").withColumn("_first", F.min("position").over(doc)).withColumn("_most", F.max("fusion").over(doc))
    df = df.withColumn("_rank", F.dense_rank().over(w.orderBy(F.desc_nulls_last("reranker"), F.asc("_first"))))
    scale = F.when(F.col("_most") > 0, F.least(F.greatest(F.col("fusion") / F.col("_most"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    df = df.withColumn("_score", F.when(F.col("reranker").isNotNull(), scale / F.log2(F.col("_rank") + 1.0)))
    tail = F.row_number().over(w.orderBy(F.col("reranker").isNotNull(), "position"))
    low = F.coalesce(F.min("_score").over(w), F.lit(0.0))
    df = df.withColumn("final_score", F.coalesce("_score", low - tail * 1e-9))
    df = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("final_score"), F.asc("position"))).cast("bigint"))
    return df.select("qid", "doc_id", "chunk_id", "position", "reranker", "final_score", "rank")


def group_by_document(results: DataFrame, limit: int) -> DataFrame:
    """(qid, doc_rank, doc_id, chunk_id, extra_matches): the first chunk of each of the first ``limit`` documents of ranked results."""
    doc = Window.partitionBy("qid", "doc_id")
    df = results.withColumn("_n", F.row_number().over(doc.orderBy("rank"))).withColumn("extra_matches", F.count("*").over(doc) - 1).where("_n = 1")
    return top_k(df, limit, ["qid"], [F.asc("rank")], "doc_rank").select("qid", "doc_rank", "doc_id", "chunk_id", "extra_matches")


def evaluation(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, recall, mrr) of ranked paths (qid, rank, path) against judgments (qid, path, relevance).

    Paths count at their first rank; gain 2^relevance - 1 and discount log2(rank + 1); queries without a relevant path
    are left out.
    """
    first = results.groupBy("qid", "path").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("qid")
    places = first.withColumn("place", F.row_number().over(w.orderBy("rank", "path"))).where(F.col("place") <= k)
    judged = judgments.where("relevance > 0").groupBy("qid", "path").agg(F.max("relevance").alias("relevance"))
    gain = F.pow(F.lit(2.0), F.col("relevance").cast("double")) - 1.0
    ideal = judged.withColumn("place", F.row_number().over(w.orderBy(F.desc("relevance"), "path")))
    ideal = ideal.groupBy("qid").agg(F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1.0))).alias("best"), F.count("*").alias("relevant"))
    hits = places.join(judged, ["qid", "path"]).groupBy("qid").agg(F.sum(gain / F.log2(F.col("place") + 1.0)).alias("dcg"), F.count("*").alias("found"), F.min("place").alias("at"))
    df = ideal.join(hits, "qid", "left")
    return df.select(
        "qid", (F.coalesce("dcg", F.lit(0.0)) / F.col("best")).alias("ndcg"), (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"), F.coalesce(1.0 / F.col("at"), F.lit(0.0)).alias("mrr")
    )
