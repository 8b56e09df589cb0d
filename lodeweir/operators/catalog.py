"""Catalogue relations: spaces, collections, documents, chunks and embeddings, their joins, counts and changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweir.functions.text import semantic_title, short_docid


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks, each chunk_id once."""
    return chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])


def current_documents(document_rows: DataFrame) -> DataFrame:
    """Newest row of every document by (recorded_at, row_id)."""
    fields = F.struct("row_id", "collection_id", "path", "title", "title_source", "hash", "modified", "active", "deactivated_at", "fts_dirty", "recorded_at")
    return document_rows.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(fields, F.struct("recorded_at", "row_id")).alias("r")).select("doc_id", "r.*")


def live_collections(collections: DataFrame) -> DataFrame:
    """Collections that are not removed."""
    return collections.where("removed_at is null").dropDuplicates(["collection_id"])


def list_spaces(collections: DataFrame) -> DataFrame:
    """(space_id, space_name, collections) of spaces with a live collection."""
    return live_collections(collections).groupBy("space_id", "space_name").agg(F.count_distinct("collection_id").alias("collections"))


def list_collections(collections: DataFrame, space: str | None = None) -> DataFrame:
    """Live collections, of one space or all."""
    df = live_collections(collections).select("collection_id", "space_name", "collection_name", "path", F.size(F.coalesce("extensions", F.array().cast("array<string>"))).cast("bigint").alias("n_extensions"))
    return df.where(F.col("space_name") == space) if space else df


def resolve_collection_names(collections: DataFrame) -> DataFrame:
    """(collection_name, spaces, resolution): found, or ambiguous where several spaces have the name."""
    n = live_collections(collections).groupBy("collection_name").agg(F.count_distinct("space_id").alias("spaces"))
    return n.withColumn("resolution", F.when(F.col("spaces") == 1, "found").otherwise("ambiguous"))


def document_by_hash_prefix(document_rows: DataFrame, prefix: str) -> DataFrame:
    """Current documents whose hash begins with ``prefix`` (letter case apart; '%' and '_' count as wildcards)."""
    return current_documents(document_rows).where(F.col("hash").ilike(prefix + "%")).select("doc_id", "path", "hash", short_docid("hash").alias("docid"))


def index_chunks(chunks: DataFrame, document_rows: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks with their document and collection: the rows of the indexes, inactive documents included."""
    docs = current_documents(document_rows).withColumn("doc_title", semantic_title("title", "title_source")).select("doc_id", "collection_id", F.col("path").alias("filepath"), "doc_title", "active", "hash")
    cols = live_collections(collections).select("collection_id", "space_name", "collection_name")
    return distinct_chunks(chunks).select("chunk_id", "doc_id", "seq", "heading", "kind", "retrieval_prefix", "text").join(docs, "doc_id").join(cols, "collection_id")


def file_list(document_rows: DataFrame, chunks: DataFrame, embeddings: DataFrame, prefix: str = "") -> DataFrame:
    """(doc_id, collection_id, path, active, chunks, embedded, is_embedded) of all current documents."""
    docs = current_documents(document_rows).select("doc_id", "collection_id", "path", "active")
    if prefix:
        docs = docs.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))
    per_chunk = distinct_chunks(chunks).select("doc_id", "chunk_id").join(embeddings.select(F.col("vec_id").alias("chunk_id")).distinct().withColumn("has", F.lit(1)), "chunk_id", "left")
    n = per_chunk.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("has").alias("embedded"))
    df = docs.join(n, "doc_id", "left").fillna(0, ["chunks", "embedded"])
    return df.withColumn("is_embedded", (F.col("chunks") > 0) & (F.col("embedded") >= F.col("chunks")))


def unembedded_chunks(chunks: DataFrame, document_rows: DataFrame, collections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Backlog: chunks of active documents of live collections without a vector."""
    live = index_chunks(chunks, document_rows, collections).where("active")
    return live.join(embeddings.select(F.col("vec_id").alias("chunk_id")).distinct(), "chunk_id", "left_anti").select("chunk_id", "doc_id", "seq", "space_name", "collection_id")


def integrity_by_space(chunks: DataFrame, document_rows: DataFrame, collections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(space_name, chunks, vectors, dimensions, consistent): whether a space's vectors have one dimension."""
    v = embeddings.select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dim"))
    df = index_chunks(chunks, document_rows, collections).select("chunk_id", "space_name").join(v, "chunk_id", "left")
    out = df.groupBy("space_name").agg(F.count("*").alias("chunks"), F.count("dim").alias("vectors"), F.count_distinct("dim").alias("dimensions"))
    return out.withColumn("consistent", F.col("dimensions") <= 1)


def status_rollup(document_rows: DataFrame, chunks: DataFrame, collections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Counts per collection, per space and in total, in one pass over grouping sets."""
    files = file_list(document_rows, chunks, embeddings)
    df = live_collections(collections).select("collection_id", "space_name", "collection_name", "updated").join(files, "collection_id", "left")
    out = df.rollup("space_name", "collection_name").agg(
        F.grouping_id().alias("level"),
        F.count("doc_id").alias("documents"), F.count_if(F.coalesce("active", F.lit(False))).alias("active_documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embedded"), F.lit(0)).alias("embedded"), F.max("updated").alias("updated"),
    )
    return out.select(F.coalesce("space_name", F.lit("*")).alias("space_name"), F.coalesce("collection_name", F.lit("*")).alias("collection_name"), F.col("level").cast("bigint").alias("level"), "documents", "active_documents", "chunks", "embedded", "updated")


def search_scope(chunks: DataFrame, document_rows: DataFrame, collections: DataFrame) -> DataFrame:
    """(space_name, collection_id, documents, chunks, has_inactive): what a search of each collection ranges over."""
    df = index_chunks(chunks, document_rows, collections)
    return df.groupBy("space_name", "collection_id").agg(F.count_distinct(F.when(F.col("active"), F.col("doc_id"))).alias("documents"), F.count_if("active").alias("chunks"), F.bool_or(~F.col("active")).alias("has_inactive"))


def scan_diff(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    """(collection_id, path, decision): a scan of files against the catalogue.

    ``scan`` has (collection_id, path, modified, hash, generation_key), ``catalog`` these and active. Same modified time and generation
    of an active row skips without looking at the hash; an equal hash skips or reactivates; else the file is new or
    changed. Active rows that the scan lacks are deactivated; inactive ones stay.
    """
    s, c = scan.alias("s"), catalog.alias("c")
    same_generation = F.col("s.generation_key").eqNullSafe(F.col("c.generation_key"))
    missing = F.col("s.path").isNull()
    decision = (
        F.when(missing & F.col("c.active"), "deactivated")
        .when(missing, "gone")
        .when(F.col("c.path").isNull(), "new")
        .when(F.col("c.active") & (F.col("s.modified") == F.col("c.modified")) & same_generation, "skipped_mtime")
        .when((F.col("s.hash") == F.col("c.hash")) & same_generation & F.col("c.active"), "skipped_hash")
        .when((F.col("s.hash") == F.col("c.hash")) & same_generation, "reactivated")
        .otherwise("changed")
    )
    keys = ["collection_id", "path"]
    on = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in keys]
    return s.join(c, on, "full_outer").select(*[F.coalesce(f"s.{k}", f"c.{k}").alias(k) for k in keys], decision.alias("decision"))


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Merge: rows of ``incoming`` replace those of ``table`` with their keys; others stay. Both have the same columns."""
    t, n = table.alias("t"), incoming.alias("n")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    new = F.col("n._hit").isNotNull()
    joined = t.join(incoming.withColumn("_hit", F.lit(1)).alias("n"), on, "full_outer")
    return joined.select(*[F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in table.columns])


def delete_where_in(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``table`` without the rows whose key is in ``keys`` (cascades, purges, hard deletes)."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def soft_delete(documents: DataFrame, gone: DataFrame, at: datetime | Column) -> DataFrame:
    """Documents with those in ``gone`` (doc_id) inactive; a first deactivated_at stays."""
    when = at if isinstance(at, Column) else F.lit(at)
    hit = documents.join(gone.select("doc_id").distinct().withColumn("_gone", F.lit(True)), "doc_id", "left")
    lost = F.coalesce("_gone", F.lit(False))
    cols = {"deactivated_at": F.when(lost, F.coalesce("deactivated_at", when.cast("timestamp_ntz"))).otherwise(F.col("deactivated_at")), "active": F.col("active") & ~lost}
    return hit.withColumns(cols).select(*documents.columns)


def reactivate(documents: DataFrame, back: DataFrame) -> DataFrame:
    """Documents with those in ``back`` (doc_id) active again."""
    hit = documents.join(back.select("doc_id").distinct().withColumn("_back", F.lit(True)), "doc_id", "left")
    back_ = F.coalesce("_back", F.lit(False))
    return hit.withColumns({"deactivated_at": F.when(~back_, F.col("deactivated_at")), "active": F.col("active") | back_}).select(*documents.columns)


def reapable(documents: DataFrame, now: datetime, days: int) -> DataFrame:
    """Inactive documents deactivated at least ``days`` before ``now``."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    return documents.where((~F.col("active")) & (F.col("deactivated_at") <= limit))


def fts_dirty_documents(document_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Current documents whose full-text entries are stale, with their number of chunks and ordered chunk ids."""
    docs = current_documents(document_rows).where("fts_dirty").select("doc_id", "collection_id", "path")
    own = distinct_chunks(chunks).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))).alias("c"))
    return docs.join(own, "doc_id", "left").select("doc_id", "collection_id", "path", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.array_join(F.transform("c", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"))


def coalesced_seq_ranges(ranges: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): overlapping and adjacent [lo, hi] ranges of each document merged."""
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    df = ranges.select("doc_id", "lo", "hi").distinct().withColumn("_reach", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_island", F.sum(F.when(F.col("lo") <= F.col("_reach") + 1, 0).otherwise(1)).over(w))
    return df.groupBy("doc_id", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def neighbor_context(chunks: DataFrame, hits: DataFrame, window: int = 1) -> DataFrame:
    """(chunk_id, doc_id, seq, neighbors, context): each hit's text with the chunks of seq within ``window`` before and after."""
    own = distinct_chunks(chunks).select("doc_id", "chunk_id", "seq", "text")
    at = own.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select("doc_id", F.col("chunk_id").alias("hit"), F.col("seq").alias("at"))
    spots = at.withColumn("seq", F.explode(F.sequence(F.col("at") - window, F.col("at") + window)))  # an equi join, not a band
    near = spots.join(own.select("doc_id", "seq", "text", F.col("chunk_id").alias("_c")), ["doc_id", "seq"])
    parts = F.array_sort(F.collect_list(F.struct("seq", "_c", "text")))
    return near.groupBy(F.col("hit").alias("chunk_id"), "doc_id", F.col("at").alias("seq")).agg(F.count("*").alias("neighbors"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))


def documents_in(document_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Current documents of a list of ids (doc_id); the rows are reduced before they are aggregated."""
    return current_documents(document_rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))


def documents_at(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents by (collection_id, path)."""
    return documents.join(wanted.select("collection_id", "path").distinct(), ["collection_id", "path"], "left_semi")


def texts_for(documents: DataFrame, texts: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, has_text, text, generation_key, extractor_key) of documents (doc_id); with ``strict`` a missing text is an error."""
    own = texts.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "generation_key", "extractor_key")).alias("x"))
    out = documents.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", F.col("x").isNotNull().alias("has_text"), "x.text", "x.generation_key", "x.extractor_key")
    if strict:
        lost = out.where("not has_text").head(1)
        if lost:
            raise ValueError(f"document {lost[0]['doc_id']} has no text")
    return out


def space_info(document_rows: DataFrame, chunks: DataFrame, collections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(space_name, collections, documents, chunks, embedded) of every space with a live collection."""
    per = collection_info(document_rows, chunks, collections, embeddings).join(live_collections(collections).select("collection_id", "space_name"), "collection_id")
    return per.groupBy("space_name").agg(F.count("*").alias("collections"), *[F.sum(c).alias(c) for c in ("documents", "chunks", "embedded")])


def collection_info(document_rows: DataFrame, chunks: DataFrame, collections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(collection_id, collection_name, documents, active_documents, chunks, embedded) of every live collection."""
    n = file_list(document_rows, chunks, embeddings).groupBy("collection_id").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("active", F.lit(False))).alias("active_documents"), F.sum("chunks").alias("chunks"), F.sum("embedded").alias("embedded"))
    return live_collections(collections).select("collection_id", "collection_name").join(n, "collection_id", "left").fillna(0, ["documents", "active_documents", "chunks", "embedded"])
