"""Search requests as plans: modes, scopes, candidate limits, reranking, context; reads of documents; incremental updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweir.functions import text as T
from lodeweir.operators import catalog as C
from lodeweir.operators import search as S
from lodeweir.operators.maintenance import checked_scores
from lodeweir.session import materialize

MODES = ("keyword", "semantic", "auto", "deep")


@dataclass
class SearchOptions:
    """How a batch of queries is run."""

    mode: str = "auto"
    limit: int = 10
    min_score: float = 0.0
    rerank: bool | None = None
    fusion: str = "dbsf"
    neighbors: int = 1
    boosts: dict[str, float] = field(default_factory=lambda: dict(S.BOOSTS))

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.fusion not in ("dbsf", "rrf", "linear"):
            raise ValueError(f"unknown mode or fusion: {self.mode}, {self.fusion}")
        if self.limit < 0:
            raise ValueError("limit may not be negative")

    def reranks(self) -> bool:
        """Deep searches rerank unless told not to, others only if asked."""
        return self.mode == "deep" if self.rerank is None else self.rerank

    def candidates(self) -> int:
        """First-stage limit."""
        return max(self.limit * (2 if self.mode == "deep" else 1), S.MIN_CANDIDATES if self.mode in ("auto", "deep") or self.reranks() else self.limit)


@dataclass
class Pipeline:
    """The steps that a search can run, and why others are left out."""

    keyword: bool
    dense: bool
    expansion: bool
    rerank: bool
    notices: list[tuple[str, str]]

    def effective_mode(self, mode: str) -> str:
        """An automatic search without vectors and reranking is a keyword search."""
        return "keyword" if mode == "auto" and not (self.dense or self.rerank) else mode


def tool_reranks(mode: str, no_rerank: bool | None = None) -> bool:
    """Whether a search asked for by a tool reranks: as it says, else not in automatic mode."""
    return mode != "auto" if no_rerank is None else not no_rerank


@dataclass
class Models:
    """Pluggable models; each may be missing. They get pandas series and are applied in Arrow batches."""

    embed: Callable[[pd.Series], pd.Series] | None = None
    rerank: Callable[[pd.Series, pd.Series], pd.Series] | None = None
    expand: Callable[[str, int], list[str]] | None = None


def expand_queries(queries: DataFrame, models: Models, most: int = 4, keep: int = 2) -> DataFrame:
    """(qid, variant, text): each query as variant 0, and its selected rewrites; equal ones (letter case apart) count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for qid, text in zip(pdf["qid"], pdf["text"], strict=True):
                found = {text.strip().lower(): text}
                for v in models.expand(text, most) if models.expand else []:
                    v = " ".join(v.split())
                    if v:
                        found.setdefault(v.lower(), v)
                variants = list(found.values())[: most + 1]
                if models.embed and len(variants) > 1:
                    chosen = S.select_variants([list(map(float, v)) for v in models.embed(pd.Series(variants))], keep)
                else:
                    chosen = range(min(len(variants), keep + 1))
                rows += [(qid, k, variants[i]) for k, i in enumerate(chosen)]
            yield pd.DataFrame(rows, columns=["qid", "variant", "text"])

    return queries.select("qid", "text").mapInPandas(run, "qid bigint, variant int, text string")


@dataclass
class Engine:
    """Indexes and catalogue of one snapshot."""

    spark: SparkSession
    entries: DataFrame
    vectors: DataFrame | None = None
    models: Models = field(default_factory=Models)
    index: S.TextIndex | None = None

    def __post_init__(self) -> None:
        self.index = self.index or S.TextIndex.build(S.with_fields(self.entries))
        if self.vectors is not None and "collection_name" not in self.vectors.columns:
            self.vectors = self.vectors.join(self.entries.select("chunk_id", "space_name", "collection_name", "active"), "chunk_id")

    def pipeline(self, opt: SearchOptions) -> Pipeline:
        """The steps of a search with these options; what is not configured is told in a notice."""
        asks_dense = opt.mode in ("semantic", "auto", "deep")
        dense = asks_dense and (opt.mode == "semantic" or (self.models.embed is not None and self.vectors is not None))
        notices = [("dense", "not configured")] if asks_dense and not dense else []
        expansion = opt.mode == "deep" and self.models.expand is not None
        if opt.mode == "deep" and not expansion:
            notices.append(("expansion", "not configured"))
        rerank = opt.reranks() and self.models.rerank is not None
        if opt.reranks() and not rerank:
            notices.append(("rerank", "not configured"))
        return Pipeline(opt.mode in ("keyword", "auto", "deep"), dense, expansion, rerank, notices)

    def _embedded(self, queries: DataFrame) -> DataFrame:
        if "vector" in queries.columns:
            return queries.select("qid", "vector")
        embed = self.models.embed
        as_vector = F.pandas_udf(lambda s: embed(s), "array<double>")
        return queries.select("qid", as_vector("text").alias("vector"))

    def _lists(self, queries: DataFrame, opt: SearchOptions) -> tuple[DataFrame, DataFrame | None]:
        k = opt.candidates()
        keyword = S.keyword_results(S.bm25_scores(queries, self.index, boosts=opt.boosts, scoped=True), k).select("qid", "chunk_id", F.col("raw").alias("score"), "rank")
        if opt.mode == "keyword" or self.vectors is None or (self.models.embed is None and "vector" not in queries.columns):
            return keyword, None
        asked = self._embedded(queries).join(queries.select("qid", *[c for c in ("space_name", "collections") if c in queries.columns]), "qid")
        return keyword, S.knn_results(asked, self.vectors, k, scoped=True).select("qid", "chunk_id", "score", "rank")

    def ranked(self, queries: DataFrame, opt: SearchOptions) -> DataFrame:
        """(qid, rank, chunk_id, score, bm25, dense, original_rank) before reranking."""
        if opt.mode == "deep":
            variants = materialize(expand_queries(queries, self.models), "variants").withColumn("vq", F.col("qid") * 64 + F.col("variant"))
            back = variants.select(F.col("vq"), F.col("qid").alias("_q"), "variant")
            extra = [c for c in ("space_name", "collections") if c in queries.columns]
            own = variants.join(queries.select("qid", *extra), "qid").select(F.col("vq").alias("qid"), "text", *extra)
            lists = materialize(self._fused(own, SearchOptions("auto", opt.candidates(), 0.0, False, opt.fusion, boosts=opt.boosts), opt.candidates()), "lists")
            merged = S.aggregate_variants(lists.join(back, F.col("qid") == F.col("vq")).select(F.col("_q").alias("qid"), "variant", "rank", "chunk_id", "bm25", "dense"))
            final = S.finalize_variants(merged, opt.candidates() if opt.reranks() else opt.limit, opt.min_score)
            return final.join(merged.select("qid", "chunk_id", "bm25", "dense"), ["qid", "chunk_id"]).select("qid", "rank", "chunk_id", "score", "bm25", "dense", "original_rank")
        return self._fused(queries, opt, opt.candidates() if opt.reranks() else opt.limit).withColumn("original_rank", F.lit(None).cast("bigint"))

    def _fused(self, queries: DataFrame, opt: SearchOptions, limit: int) -> DataFrame:
        keyword, dense = self._lists(queries, opt)
        none = keyword.where(F.lit(False))
        if opt.mode == "semantic":
            if dense is None:
                raise ValueError("semantic search needs vectors and an embedder")
            keyword = none
        fuse = {"dbsf": S.fuse_dbsf, "rrf": S.fuse_rrf, "linear": S.fuse_linear}[opt.fusion]
        return fuse(keyword, none if dense is None else dense, limit, min_score=opt.min_score)

    def search(self, queries: DataFrame, opt: SearchOptions | None = None) -> DataFrame:
        """(qid, rank, chunk_id, doc_id, path, space_name, collection_name, heading, docid, score, bm25, dense, reranker, text).

        ``queries`` have qid and text, and optionally a vector, space_name and collections. Texts are joined last, to the
        final rows alone; an empty query, or a limit of 0, has no results.
        """
        opt = opt or SearchOptions()
        queries = queries.withColumn("text", T.normalized_query("text")).where("text <> ''")
        ranked = materialize(self.ranked(queries, opt).where(F.lit(opt.limit > 0)), "ranked")  # a few rows a query, read several times
        facts = self.entries.select("chunk_id", "doc_id", "seq", F.col("filepath").alias("path"), "space_name", "collection_name", "heading", T.short_docid("hash").alias("docid"))
        rows = ranked.join(facts, "chunk_id")
        if opt.reranks() and self.models.rerank:
            rows = self._reranked(queries, rows, opt)
        else:
            rows = rows.withColumn("reranker", F.lit(None).cast("double"))
        rows = rows.where(F.col("rank") <= opt.limit)
        texts = self.entries.select("chunk_id", "doc_id", "seq", "text")
        context = C.neighbor_context(texts, rows, opt.neighbors) if opt.neighbors else texts.withColumn("context", F.col("text"))
        return rows.join(context.select("chunk_id", F.col("context").alias("text")), "chunk_id").select("qid", "rank", "chunk_id", "doc_id", "path", "space_name", "collection_name", "heading", "docid", "score", "bm25", "dense", "reranker", "text")

    def _reranked(self, queries: DataFrame, rows: DataFrame, opt: SearchOptions) -> DataFrame:
        most = max(S.RERANK_MIN, min(opt.limit, S.RERANK_MAX))
        positions = rows.withColumn("position", F.col("rank")).withColumn("fusion", F.col("score"))
        picks = S.rerank_representatives(positions.select("qid", "position", "doc_id", "chunk_id", "original_rank"), most, -(-most // 2) if opt.mode == "deep" else 0)
        body = T.contextual_text(T.retrieval_body("retrieval_prefix", "text"), F.coalesce("doc_title", F.lit("")), F.coalesce("heading", F.lit("")))
        inputs = picks.join(self.entries.select("chunk_id", body.alias("document")), "chunk_id").join(queries.select("qid", F.col("text").alias("query")), "qid")
        model = self.models.rerank
        score = F.pandas_udf(lambda q, doc: pd.Series(checked_scores(list(enumerate(map(float, model(q, doc)))), len(q)), dtype="float64"), "double")
        scored = inputs.select("qid", "doc_id", score("query", "document").alias("reranker"))
        done = S.apply_rerank(positions.select("qid", "position", "doc_id", "chunk_id", "fusion"), scored)
        return rows.drop("rank", "score").join(done.select("qid", "chunk_id", "reranker", F.col("final_score").alias("score"), "rank"), ["qid", "chunk_id"])


def get_documents(documents: DataFrame, texts: DataFrame, locators: DataFrame, offset: int = 0, lines: int | None = None) -> DataFrame:
    """(locator, matches, doc_id, path, docid, content, total_lines, returned_lines) of documents by path or docid.

    ``documents`` are current rows; a locator with several matches has ``matches`` over 1 and no content, one without
    any 0. Content is the window of ``lines`` lines from ``offset``.
    """
    docs = documents.select("doc_id", "path", T.short_docid("hash").alias("docid"), F.lower("hash").alias("_h"))
    loc = locators.select("locator").distinct().withColumn("_id", F.lower(T.normalized_docid("locator")))
    by_path = loc.where(T.is_locator_path("locator")).join(docs, F.col("locator") == F.col("path"))
    by_id = loc.where(~T.is_locator_path("locator")).join(docs, (F.substring("_h", 1, 6) == F.substring("_id", 1, 6)) & F.col("_h").startswith(F.col("_id")))
    found = by_path.unionByName(by_id)
    n = found.groupBy("locator").agg(F.count("*").alias("matches"), F.min(F.struct("doc_id", "path", "docid")).alias("d"))
    one = n.where("matches = 1").select("locator", "d.*").join(texts.select("doc_id", "text"), "doc_id", "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    window = F.slice(split, offset + 1, lines) if lines is not None else F.slice(split, offset + 1, 1 << 30)
    body = one.select("locator", "doc_id", "path", "docid", F.array_join(window, "\n").alias("content"), F.size(split).cast("bigint").alias("total_lines"), F.size(window).cast("bigint").alias("returned_lines"))
    return loc.select("locator").join(n.select("locator", "matches"), "locator", "left").join(body, "locator", "left").fillna(0, ["matches"])


def snippet(text: str | F.Column, lines: int = 4) -> F.Column:
    """First lines of a text, and how many more there are."""
    parts = F.split(T.col(text), "\n", -1)
    more = F.size(parts) - lines
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n(+"), more.cast("string"), F.lit(" more lines)"))).otherwise(T.col(text))


def embed_backlog(chunks: DataFrame, embed: Callable[[pd.Series], pd.Series], hard_max: int | None = None) -> DataFrame:
    """(chunk_id, embedding, error) of chunks (chunk_id, text): batches that fail are halved until the failing texts stand alone."""

    def halves(texts: pd.Series) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(list(map(float, v)), None) for v in embed(texts)]
        except Exception as e:  # noqa: BLE001
            if len(texts) == 1:
                return [(None, str(e)[:500])]
            mid = len(texts) // 2
            return halves(texts.iloc[:mid]) + halves(texts.iloc[mid:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                done = halves(part["text"])
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": [v for v, _ in done], "error": [e for _, e in done]})

    rows = chunks.select("chunk_id", "text").where("text is not null")
    if hard_max is not None:
        rows = rows.where(F.size(T.whitespace_tokens("text")) <= hard_max)
    return rows.mapInPandas(run, "chunk_id bigint, embedding array<double>, error string")


def update_report(decisions: DataFrame) -> DataFrame:
    """(decision, files): how many files each decision of a scan has."""
    return decisions.groupBy("decision").agg(F.count("*").alias("files"))


