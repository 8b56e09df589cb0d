"""Durable text index and vectors, as versioned tables: put, delete, commit, reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweir.operators.search import TextIndex, analyzed_entries
from lodeweir.sources.versioned import VersionedTable

_TERMS = "space_name string, collection_name string, doc_id bigint, chunk_id bigint, active boolean, field string, terms array<string>"
_VECTORS = "space_name string, chunk_id bigint, model string, vector array<double>"


class IndexStore:
    """Analysed entries by chunk; every put or delete is one commit, and a reader holds the postings of one commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.table = VersionedTable(spark, f"{root}/terms", spark.createDataFrame([], _TERMS).schema)

    def put(self, entries: DataFrame) -> int:
        """Add entries with the searched fields; chunks that are there already are replaced."""
        return self.table.replace_where(entries, ["chunk_id"], analyzed_entries(entries))

    def delete(self, keys: DataFrame, on: str = "chunk_id") -> int:
        """Delete chunks (chunk_id) or documents (doc_id)."""
        return self.table.replace_where(keys, [on])

    def reader(self) -> TextIndex:
        """The index of the latest commit; its postings are written when it is first read."""
        path = f"{self.root}/readers/{self.table.latest()}"
        index = TextIndex.read(self.spark, path)
        if index is None:
            TextIndex.of_terms(self.table.snapshot()).write(path)
            index = TextIndex.read(self.spark, path)
        return index


class VectorStore:
    """Vectors and the model that made them, by space; a space has one dimension."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.table = VersionedTable(spark, f"{root}/vectors", spark.createDataFrame([], _VECTORS).schema)
        self.waiting: dict[str, list[DataFrame]] = {}

    def put(self, vectors: DataFrame) -> int:
        """Add vectors (space_name, chunk_id, model, vector), replacing those of their chunks. Another dimension is an error."""
        known = {k.removeprefix("dimension."): v for k, v in self.table.properties().items() if k.startswith("dimension.")}
        sizes = vectors.groupBy("space_name").agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).collect()  # a row per space
        for r in sizes:
            if r["least"] != r["most"] or (known.get(r["space_name"]) or r["most"]) != r["most"]:
                raise ValueError(f"space {r['space_name']}: dimensions {r['least']} to {r['most']}, stored {known.get(r['space_name'])}")
        return self.table.replace_where(vectors, ["chunk_id"], vectors, {f"dimension.{r['space_name']}": r["most"] for r in sizes})

    def defer(self, space: str, vectors: DataFrame) -> None:
        """Keep vectors of a space for the next flush."""
        self.waiting.setdefault(space, []).append(vectors)

    def flush(self) -> list[str]:
        """Store what was deferred, space by space in their order; a space that fails, and those behind it, stay deferred."""
        done = []
        for space in sorted(self.waiting):
            frames = self.waiting[space]
            rows = frames[0]
            for more in frames[1:]:
                rows = rows.unionByName(more)
            self.put(rows.where(F.col("space_name") == space))
            del self.waiting[space]
            done.append(space)
        return done

    def delete(self, chunks: DataFrame) -> int:
        """Delete the vectors of chunks (chunk_id)."""
        return self.table.replace_where(chunks, ["chunk_id"])

    def clear(self, space: str) -> int:
        """Delete all vectors of a space; it may have another dimension afterwards."""
        gone = self.table.snapshot().where(F.col("space_name") == space)
        return self.table.replace_where(gone, ["chunk_id"], None, {f"dimension.{space}": None}) if self.table.latest() else 0

    def models(self) -> DataFrame:
        """(space_name, model) of the vectors, each once."""
        return embedding_models(self.table.snapshot())


def embedding_models(vectors: DataFrame) -> DataFrame:
    """(space_name, model) of vectors, each once."""
    return vectors.where("model is not null").select("space_name", "model").distinct()
