"""A library of collections on disk: updates from walk to index and vectors, replay, evaluation runs, reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweir.functions import text as T
from lodeweir.operators import catalog as C
from lodeweir.operators import search as S
from lodeweir.operators.chunking import ChunkPolicy, chunk_documents, generation_key, resolve_policy
from lodeweir.operators.extract import EXTENSIONS, VERSIONS, extract_documents, extractor_column
from lodeweir.operators.stores import IndexStore, VectorStore
from lodeweir.plans.engine import Engine, Models, SearchOptions, embed_backlog
from lodeweir.session import materialize
from lodeweir.sources.files import read_files, under_failed_walk, walk_collection
from lodeweir.sources.versioned import VersionedTable

_TABLES = {
    "documents": "doc_id bigint, collection_id bigint, path string, title string, title_source string, hash string, modified bigint, generation_key string, active boolean, deactivated_at timestamp, fts_dirty boolean",
    "texts": "doc_id bigint, extractor_key string, source_hash string, text_hash string, generation_key string, text string",
    "chunks": "chunk_id bigint, doc_id bigint, seq int, byte_offset bigint, byte_length bigint, heading string, kind string, retrieval_prefix string, text string",
}


@dataclass(frozen=True)
class Collection:
    """A folder to index."""

    collection_id: int
    space_name: str
    collection_name: str
    path: str
    extensions: tuple[str, ...] = ()
    patterns: str = ""


def resolve_targets(collections: list[Collection], wanted: list[tuple[str | None, str]] | None) -> list[Collection]:
    """The collections that an update is asked for, each once and in order: all, or (space or None, name); unknown and ambiguous names are errors."""
    if wanted is None:
        return list(collections)
    out: dict[int, Collection] = {}
    for space, name in wanted:
        hits = [c for c in collections if c.collection_name == name and space in (None, c.space_name)]
        if len(hits) != 1:
            raise ValueError(f"collection {name}: " + ("unknown" if not hits else "in several spaces, name one"))
        out[hits[0].collection_id] = hits[0]
    return list(out.values())


def repair_scope(collections: list[Collection], targets: list[Collection], whole: bool) -> tuple[str, list]:
    """What an integrity repair may touch: everything, whole spaces, or the collections alone."""
    if whole or {c.collection_id for c in targets} == {c.collection_id for c in collections}:
        return "global", []
    spaces = {c.space_name for c in targets}
    if {c.collection_id for c in collections if c.space_name in spaces} == {c.collection_id for c in targets}:
        return "spaces", sorted(spaces)
    return "collections", sorted(c.collection_id for c in targets)


@dataclass
class UpdateReport:
    """What an update did: decisions per collection, documents that could not be extracted, chunks indexed and embedded."""

    decisions: list[tuple[str, str, int]] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    indexed: int = 0
    replayed: int = 0
    embedded: int = 0
    rejected: int = 0


class Library:
    """Documents, texts, chunks, index and vectors below ``root``, each a versioned table."""

    def __init__(self, spark: SparkSession, root: str, collections: list[Collection]):
        self.spark, self.root, self.collections = spark, root, collections
        self.documents, self.texts, self.chunks = (VersionedTable(spark, f"{root}/{n}", spark.createDataFrame([], s).schema) for n, s in _TABLES.items())
        self.index, self.vectors = IndexStore(spark, f"{root}/index"), VectorStore(spark, root)

    def _homes(self) -> DataFrame:
        rows = [(c.collection_id, c.space_name, c.collection_name) for c in self.collections]
        return F.broadcast(self.spark.createDataFrame(rows, "collection_id bigint, space_name string, collection_name string"))  # the registered collections

    def entries(self, documents: DataFrame | None = None) -> DataFrame:
        """Index rows of all documents, or of those in ``documents`` (doc_id)."""
        docs = self.documents.snapshot().withColumn("doc_title", T.semantic_title("title", "title_source")).select("doc_id", "collection_id", F.col("path").alias("filepath"), "doc_title", "active", "hash")
        if documents is not None:
            docs = docs.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
        return self.chunks.snapshot().join(docs, "doc_id").join(self._homes(), "collection_id")

    def replay(self) -> int:
        """Index again what an earlier run left dirty, and clear the flags; returns the number of documents."""
        dirty = materialize(self.documents.snapshot().where("fts_dirty").select("doc_id"), "dirty")
        n = dirty.count()
        if n:
            if self.index.table.latest():
                self.index.delete(dirty, "doc_id")
            self.index.put(materialize(S.with_fields(self.entries(dirty)), "entries"))
            clean = self.documents.snapshot().join(dirty, "doc_id", "left_semi").withColumn("fts_dirty", F.lit(False))
            self.documents.merge(materialize(clean, "clean"), "doc_id", unchanged=lambda o, n: F.lit(False), present=F.lit(True))
        return n

    def update(self, wanted: list[tuple[str | None, str]] | None = None, models: Models | None = None, now: pd.Timestamp | None = None, policy: ChunkPolicy | None = None, hard_max: int | None = None, model_name: str = "model") -> UpdateReport:
        """Walk, classify, extract, chunk, index and embed the collections; see UpdateReport.

        Documents are committed with their full-text flag set, indexed, and cleared, so that a run that stops in between is made good
        by the next one's replay. A file that cannot be extracted keeps its old generation, and files below a folder that could not be read
        stay active. Chunks without a vector are embedded last, also those of earlier runs.
        """
        report, stamp = UpdateReport(), F.lit(now or pd.Timestamp.now()).cast("timestamp")
        report.replayed = self.replay()
        for c in resolve_targets(self.collections, wanted):
            self._update(c, report, stamp, policy)
        report.indexed = self.replay()
        if models and models.embed:
            report.embedded, report.rejected = self.embed(models, hard_max, model_name)
        return report

    def _update(self, c: Collection, report: UpdateReport, stamp, policy: ChunkPolicy | None) -> None:
        failed: list[str] = []
        keys = {k: generation_key(k, VERSIONS[k], resolve_policy(k, policy)) for k in EXTENSIONS}
        generation = F.element_at(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]), F.col("extractor_key"))
        scan = walk_collection(self.spark, c.path, list(c.extensions), c.patterns, failed).withColumn("extractor_key", extractor_column("rel_path")).where("extractor_key is not null")
        scan = scan.select("full_path", "rel_path", F.col("rel_path").alias("path"), "modified", "extractor_key", generation.alias("generation_key"))
        known = self.documents.snapshot().where(F.col("collection_id") == c.collection_id)
        same = known.where("active").select("path", "modified", "generation_key")
        looked = materialize(read_files(scan.join(same, ["path", "modified", "generation_key"], "left_anti")), "looked")
        whole = scan.join(looked.select("path", "hash"), "path", "left").withColumn("collection_id", F.lit(c.collection_id).cast("bigint"))
        decided = materialize(C.scan_diff(whole.select("collection_id", "path", "modified", "hash", "generation_key"), known.select("collection_id", "path", "modified", "hash", "generation_key", "active")).withColumn("decision", F.when((F.col("decision") == "deactivated") & under_failed_walk("path", failed), "unreadable").otherwise(F.col("decision"))), "decided")
        report.decisions += [(c.collection_name, r["decision"], r["count"]) for r in decided.groupBy("decision").count().orderBy("decision").collect()]
        fresh = looked.join(decided.where("decision in ('new', 'changed')").select("path"), "path", "left_semi").withColumn("doc_id", F.xxhash64(F.lit(c.collection_id), "path"))
        done = materialize(extract_documents(fresh.select("doc_id", "extractor_key", "text", "content", "path")), "extracted")
        report.errors += [(r["path"], r["error"]) for r in done.where("error is not null").join(fresh, "doc_id").select("path", "error").orderBy("path").collect()]
        unreadable = fresh.where("text is null and extractor_key <> 'pdf'")
        report.errors += [(r["path"], "not UTF-8") for r in unreadable.select("path").orderBy("path").collect()]
        good = done.where("error is null").select("doc_id", F.col("title").alias("found"), F.col("text").alias("canonical"), "blocks").join(fresh.drop("text", "content"), "doc_id")
        pieces = chunk_documents(good.select("doc_id", "extractor_key", F.col("canonical").alias("text"), "blocks"), {k: policy for k in EXTENSIONS} if policy else None)
        chunks = materialize(pieces.select(F.xxhash64("doc_id", "seq", "text").alias("chunk_id"), "doc_id", "seq", F.col("offset").alias("byte_offset"), F.col("length").alias("byte_length"), "heading", "kind", "retrieval_prefix", "text"), "chunks")
        old = self.chunks.snapshot().join(good.select("doc_id"), "doc_id", "left_semi")
        if self.vectors.table.latest():
            self.vectors.delete(materialize(old.select("chunk_id"), "old"))
        self.chunks.replace_where(good, ["doc_id"], chunks)
        self.texts.replace_where(good, ["doc_id"], good.select("doc_id", "extractor_key", F.col("hash").alias("source_hash"), F.sha2("canonical", 256).alias("text_hash"), "generation_key", F.col("canonical").alias("text")))
        title = F.coalesce(F.when(F.trim("found") != "", F.col("found")), T.file_title("path"))
        rows = good.select("doc_id", F.lit(c.collection_id).cast("bigint").alias("collection_id"), "path", title.alias("title"), F.when(F.trim("found") != "", "extracted").otherwise("filename").alias("title_source"), "hash", "modified", "generation_key", F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("deactivated_at"), F.lit(True).alias("fts_dirty"))
        # unchanged content with another time or a row that comes back: the old record, its times and flags renewed
        again = decided.where("decision in ('skipped_hash', 'reactivated', 'deactivated')").select("path", "decision").join(whole.select("path", F.col("modified").alias("seen")), "path", "left")
        kept = known.join(again, "path").withColumn("modified", F.coalesce("seen", "modified")).withColumn("fts_dirty", F.col("fts_dirty") | (F.col("decision") != "skipped_hash"))
        kept = kept.withColumn("deactivated_at", F.when(F.col("decision") == "deactivated", F.coalesce("deactivated_at", stamp))).withColumn("active", F.col("decision") != "deactivated")
        self.documents.merge(materialize(rows.unionByName(kept.select(*rows.columns)), "documents"), "doc_id", unchanged=lambda o, n: F.lit(False), present=F.lit(True))

    def embed(self, models: Models, hard_max: int | None = None, model_name: str = "model") -> tuple[int, int]:
        """Embed all chunks of active documents without a vector; returns how many were stored and how many failed or were too long."""
        have = self.vectors.table.snapshot().select("chunk_id").distinct()
        todo = materialize(self.entries().where("active").join(have, "chunk_id", "left_anti").select("chunk_id", "space_name", "text"), "backlog")
        made = materialize(embed_backlog(todo, models.embed, hard_max), "embedded")
        stored = made.where("embedding is not null").join(todo.select("chunk_id", "space_name"), "chunk_id")
        rows = materialize(stored.select("space_name", "chunk_id", F.lit(model_name).alias("model"), F.col("embedding").alias("vector")), "vectors")
        n = rows.count()
        if n:
            self.vectors.put(rows)
        return n, todo.count() - n

    def engine(self, models: Models | None = None) -> Engine:
        """A search engine over the latest commits."""
        vectors = self.vectors.table.snapshot().select("chunk_id", "vector") if self.vectors.table.latest() else None
        return Engine(self.spark, self.entries(), vectors, models or Models(), self.index.reader())

    def empty_hint(self, space: str | None = None, wanted: list[str] | None = None) -> str | None:
        """What to do where a search can find nothing: no collection in its scope, or none of the named ones has chunks."""
        scope = [c for c in self.collections if space in (None, c.space_name) and (not wanted or c.collection_name in wanted)]
        if not scope:
            return "no collections registered yet"
        if wanted and not self.entries().where(F.col("collection_id").isin([c.collection_id for c in scope])).head(1):
            return "no indexed content in selected collection(s): " + ", ".join(c.collection_name for c in scope)
        return None


def evaluation_modes(models: Models) -> list[tuple[str, bool]]:
    """(mode, rerank) of an evaluation; semantic alone needs an embedder."""
    return [("keyword", False), ("auto", False), ("auto", True), *([("semantic", False)] if models.embed else []), ("deep", False), ("deep", True)]


def check_cases(cases: DataFrame, entries: DataFrame) -> list[str]:
    """Faults of cases (qid, space_name, collections): scopes that hold no chunks."""
    homes = entries.groupBy("space_name", "collection_name").agg(F.count("*").alias("n")).select(F.col("space_name").alias("s"), F.col("collection_name").alias("c"), "n")
    wanted = cases.select("qid", "space_name", F.explode_outer("collections").alias("collection_name"))
    fits = (F.col("space_name").isNull() | (F.col("space_name") == F.col("s"))) & (F.col("collection_name").isNull() | (F.col("collection_name") == F.col("c")))
    empty = wanted.join(F.broadcast(homes), fits, "left").groupBy("qid", "space_name", "collection_name").agg(F.sum("n").alias("n")).where("n is null")  # a row per collection
    return [f"case {r['qid']}: nothing in {r['space_name'] or 'any space'}/{r['collection_name'] or '*'}" for r in empty.orderBy("qid", "collection_name").collect()]


def evaluate(engine: Engine, cases: DataFrame, judgments: DataFrame, limit: int = 10, search: Callable | None = None) -> tuple[DataFrame, dict[str, str]]:
    """((mode, rerank, queries, ndcg, recall, mrr), failures by mode): all cases in one plan per mode; a mode that fails stops no other.

    Paths are bare where a case has a space, else they begin with the space; judgments have (qid, path, relevance).
    """
    rows, failures = [], {}
    spaces = cases.select("qid", F.col("space_name").alias("_space"))
    for mode, rerank in evaluation_modes(engine.models):
        try:
            found = (search or engine.search)(cases, SearchOptions(mode=mode, limit=limit, rerank=rerank, neighbors=0))
            path = F.concat_ws("/", F.when(F.col("_space").isNull(), F.col("space_name")), "collection_name", "path")
            m = S.evaluation(found.join(spaces, "qid").select("qid", "rank", path.alias("path")), judgments, limit)
            rows.append(m.agg(F.count("*"), F.avg("ndcg"), F.avg("recall"), F.avg("mrr")).first())
            rows[-1] = (mode, rerank, *rows[-1])
        except Exception as e:  # noqa: BLE001
            failures[f"{mode}{'+rerank' if rerank else ''}"] = str(e)[:500]
    return cases.sparkSession.createDataFrame(rows, "mode string, rerank boolean, queries bigint, ndcg double, recall double, mrr double"), failures
