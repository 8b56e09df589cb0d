"""Changes of spaces, collections, documents and indexes as functions from tables to tables; see sources.versioned for commits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SPACE = "default"


def _absent(table: DataFrame, condition: Column, what: str) -> None:
    if table.where(condition).head(1):
        raise ValueError(f"{what} exists")


def create_space(spaces: DataFrame, name: str, description: str | None = None) -> DataFrame:
    """Spaces (space_id, name, description, created) and one more; a name occurs once."""
    if not name.strip():
        raise ValueError("a space needs a name")
    _absent(spaces, F.col("name") == name, f"space {name}")
    new = spaces.agg((F.coalesce(F.max("space_id"), F.lit(0)) + 1).alias("space_id")).select("space_id", F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.current_timestamp().cast(spaces.schema["created"].dataType).alias("created"))
    return spaces.unionByName(new)


def delete_space(spaces: DataFrame, collections: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spaces and collections without a space; the default space stays, emptied."""
    gone = spaces.where(F.col("name") == name).select("space_id")
    left = spaces.where((F.col("name") != name) | (F.col("name") == DEFAULT_SPACE))
    return left, collections.join(gone, "space_id", "left_anti")


def rename(table: DataFrame, key: Column, column: str, name: str, within: Column | None = None) -> DataFrame:
    """``table`` with ``column`` of the row at ``key`` set to ``name``, which no other row (of ``within``) has."""
    _absent(table.where(within) if within is not None else table, (F.col(column) == name) & ~key, name)
    return table.withColumn(column, F.when(key, F.lit(name)).otherwise(F.col(column)))


def describe(table: DataFrame, key: Column, description: str | None) -> DataFrame:
    """``table`` with another description in the row at ``key``."""
    return table.withColumn("description", F.when(key, F.lit(description).cast("string")).otherwise(F.col("description")))


def touch(table: DataFrame, key: Column, at: Column) -> DataFrame:
    """``table`` with ``updated`` set in the rows at ``key``."""
    return table.withColumn("updated", F.when(key, at.cast(table.schema["updated"].dataType)).otherwise(F.col("updated")))


def create_collection(collections: DataFrame, row: DataFrame) -> DataFrame:
    """Collections and one more row; (space_id, collection_name) occurs once."""
    if collections.where("removed_at is null").join(row, ["space_id", "collection_name"], "left_semi").head(1):
        raise ValueError("the collection exists")
    return collections.unionByName(row, allowMissingColumns=True)


@dataclass
class Snapshot:
    """Tables that change together."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    texts: DataFrame

    def without_documents(self, gone: DataFrame) -> Snapshot:
        """Documents with their texts, chunks and vectors deleted."""
        ids = gone.select("doc_id").distinct()
        lost = self.chunks.join(ids, "doc_id", "left_semi").select(F.col("chunk_id").alias("vec_id"))
        return Snapshot(*[t.join(ids, "doc_id", "left_anti") for t in (self.documents, self.chunks)], self.embeddings.join(lost, "vec_id", "left_anti"), self.texts.join(ids, "doc_id", "left_anti"))

    def without_collections(self, gone: DataFrame) -> Snapshot:
        """Everything of collections (collection_id) deleted."""
        return self.without_documents(self.documents.join(gone.select("collection_id").distinct(), "collection_id", "left_semi"))

    def replace_generation(self, documents: DataFrame, texts: DataFrame, chunks: DataFrame) -> Snapshot:
        """New versions of documents, their texts and chunks, after a check of all spans; old chunks lose their vectors."""
        from lodeweir.functions.text import byte_slice

        spans = chunks.join(texts.select("doc_id", F.col("text").alias("_whole")), "doc_id", "left")
        bad = spans.where(~F.col("text").eqNullSafe(byte_slice("_whole", "byte_offset", "byte_length"))).head(1)
        if bad:
            raise ValueError(f"chunk {bad[0]['chunk_id']} is no slice of its document")
        old = self.without_documents(documents)
        return Snapshot(old.documents.unionByName(documents, allowMissingColumns=True), old.chunks.unionByName(chunks, allowMissingColumns=True), old.embeddings, old.texts.unionByName(texts, allowMissingColumns=True))


def clear_dirty(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents with the full-text flag of those in ``done`` cleared."""
    hit = documents.join(done.select("doc_id").distinct().withColumn("_done", F.lit(True)), "doc_id", "left")
    return hit.withColumn("fts_dirty", F.col("fts_dirty") & F.col("_done").isNull()).select(*documents.columns)


def keyset_page(table: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows behind a key."""
    return table.where(F.col(key) > after).orderBy(key).limit(size)


def preflight(chunks: DataFrame, hard_max: int) -> tuple[DataFrame, DataFrame]:
    """(doc_ids whose chunks all fit, rejected chunks): one oversized chunk keeps its document's old generation."""
    sized = chunks.withColumn("_n", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")))
    return sized.groupBy("doc_id").agg(F.bool_and(F.col("_n") <= hard_max).alias("ok")).where("ok").select("doc_id"), sized.where(F.col("_n") > hard_max).drop("_n")


def dense_repair(ledger: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(space_name, ledger, vectors, repair): spaces whose ledger knows another model, or another number of vectors, are rebuilt.

    ``ledger`` has (space_name, chunk_id, model), ``vectors`` (space_name, chunk_id).
    """
    a = ledger.groupBy("space_name").agg(F.count_distinct("chunk_id").alias("ledger"), F.bool_and(F.col("model") == model).alias("_same"))
    b = vectors.groupBy("space_name").agg(F.count_distinct("chunk_id").alias("vectors"))
    both = a.join(b, "space_name", "full_outer").fillna(0, ["ledger", "vectors"])
    return both.select("space_name", "ledger", "vectors", ((F.col("ledger") != F.col("vectors")) | ~F.coalesce("_same", F.lit(True))).alias("repair"))


def shard_ranges(n: int, shards: int) -> list[tuple[int, int]]:
    """[start, end) of at most ``shards`` balanced parts of ``n`` items."""
    k = max(1, min(shards, n)) if n else 0
    base, more = divmod(n, k) if k else (0, 0)
    out, at = [], 0
    for i in range(k):
        size = base + (i < more)
        out.append((at, at + size))
        at += size
    return out


def checked_scores(scores: list[tuple[int, float]], n: int) -> list[float]:
    """Scores by index of ``n`` documents; indexes are a permutation, scores finite, and clamped to 0..1."""
    if sorted(i for i, _ in scores) != list(range(n)):
        raise ValueError("scores are no permutation of the documents")
    if any(s != s or s in (float("inf"), float("-inf")) for _, s in scores):
        raise ValueError("scores must be finite")
    by = dict(scores)
    return [min(1.0, max(0.0, by[i])) for i in range(n)]
