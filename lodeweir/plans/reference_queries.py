"""Queries for catalogue, retrieval, evaluation and maintenance operators, each with the SQL that says the same.

Floats are rounded to six decimals on both sides; counts are bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweir.functions import text as T
from lodeweir.operators import catalog as C
from lodeweir.operators import search as S
from lodeweir.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2026, 1, 1)

_DOCS = """docs AS (SELECT * FROM document_rows WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY recorded_at DESC, row_id DESC) = 1),
cols AS (SELECT DISTINCT collection_id, space_id, space_name, collection_name, path, extensions, updated FROM collections WHERE removed_at IS NULL),
ch AS (SELECT DISTINCT * FROM chunks WHERE chunk_id IS NOT NULL),
idx AS (SELECT ch.chunk_id, ch.doc_id, ch.seq, ch.heading, ch.kind, ch.retrieval_prefix, ch.text, d.collection_id, d.path AS filepath,
          CASE WHEN d.title_source = 'extracted' AND trim(d.title) <> '' THEN trim(d.title) END AS doc_title, d.active, d.hash, c.space_name, c.collection_name
        FROM ch JOIN docs d USING (doc_id) JOIN cols c ON c.collection_id = d.collection_id)"""
_FIELDS = (
    _DOCS
    + """,
lined AS (SELECT *, CASE WHEN trim(coalesce(retrieval_prefix, '')) <> '' THEN retrieval_prefix || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS b,
    concat_ws(chr(10), CASE WHEN trim(coalesce(doc_title, '')) <> '' THEN 'title: ' || trim(doc_title) END, CASE WHEN trim(coalesce(heading, '')) <> '' THEN 'heading: ' || trim(heading) END) AS l FROM idx),
entries AS (SELECT space_name, collection_id, doc_id, chunk_id, active, coalesce(filepath, '') AS filepath, coalesce(doc_title, '') AS title, coalesce(heading, '') AS heading,
    CASE WHEN l <> '' THEN l || chr(10) || chr(10) || b ELSE b END AS body FROM lined),
fields AS (SELECT space_name, chunk_id, 'title' AS field, title AS v FROM entries UNION ALL SELECT space_name, chunk_id, 'heading', heading FROM entries
    UNION ALL SELECT space_name, chunk_id, 'body', body FROM entries UNION ALL SELECT space_name, chunk_id, 'filepath', filepath FROM entries),
terms AS (SELECT space_name, chunk_id, field, list_filter(regexp_split_to_array(lower(v), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40) AS terms FROM fields),
lens AS (SELECT space_name, chunk_id, field, len(terms) AS len FROM terms),
stats AS (SELECT space_name, field, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY 1, 2),
post AS (SELECT space_name, field, chunk_id, len, term, count(*) AS tf FROM (SELECT space_name, field, chunk_id, len(terms) AS len, unnest(terms) AS term FROM terms) GROUP BY 1, 2, 3, 4, 5),
dfs AS (SELECT space_name, field, term, count(*) AS df FROM post GROUP BY 1, 2, 3),
qt AS (SELECT DISTINCT case_id AS qid, unnest(list_filter(regexp_split_to_array(lower(query_text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40)) AS term FROM eval_cases),
w AS (SELECT p.space_name, p.chunk_id, p.term, CASE p.field WHEN 'title' THEN 2.0 WHEN 'heading' THEN 1.5 WHEN 'body' THEN 1.0 ELSE 0.5 END::DOUBLE * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
        / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.len / s.avg_len)) AS w FROM post p JOIN dfs d USING (space_name, field, term) JOIN stats s USING (space_name, field) WHERE p.term IN (SELECT term FROM qt)),
scores AS (SELECT qt.qid, w.space_name, w.chunk_id, sum(w.w) AS score FROM w JOIN qt USING (term) GROUP BY 1, 2, 3)"""
)


def _top(scores: str, limit: int = 10) -> str:
    return f"""per_space AS (SELECT * FROM {scores} QUALIFY row_number() OVER (PARTITION BY qid, space_name ORDER BY round(score, 9) DESC, chunk_id) <= {limit}),
merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM per_space QUALIFY rank <= {limit})
SELECT qid, rank, chunk_id, space_name, round(score, 6) AS raw, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM merged"""


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    """Tables by name."""
    return [table(spark, d, n) for n in names]


def _index_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.index_chunks(*tables(spark, d, "chunks", "document_rows", "collections"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").where("case_id is not null").dropDuplicates(["case_id"]).select(F.col("case_id").alias("qid"), F.col("query_text").alias("text"), "space_name", F.col("collection_names").alias("collections"))


def _index(spark: SparkSession, d: str) -> S.TextIndex:
    from lodeweir.plans.demo_models import demo_index

    return demo_index(spark, d)[1]


def _scores(spark: SparkSession, d: str, scoped: bool = False) -> DataFrame:
    return S.bm25_scores(_queries(spark, d), _index(spark, d), scoped=scoped).withColumn("score", F.round("score", 9))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# -- catalogue


@query("WITH " + _DOCS + " SELECT space_id, space_name, count(DISTINCT collection_id) AS collections FROM cols GROUP BY 1, 2")
def space_list(spark, d):
    """Spaces with their collections."""
    return C.list_spaces(table(spark, d, "collections"))


@query("WITH " + _DOCS + " SELECT collection_id, space_name, collection_name, path, coalesce(len(extensions), 0) AS n_extensions FROM cols")
def collection_list(spark, d):
    """Live collections."""
    return C.list_collections(table(spark, d, "collections"))


@query("WITH " + _DOCS + " SELECT collection_name, count(DISTINCT space_id) AS spaces, CASE WHEN count(DISTINCT space_id) = 1 THEN 'found' ELSE 'ambiguous' END AS resolution FROM cols GROUP BY 1")
def collection_resolution(spark, d):
    """Names of collections, found or ambiguous."""
    return C.resolve_collection_names(table(spark, d, "collections"))


@query("WITH " + _DOCS + " SELECT doc_id, path, hash, '#' || substr(hash, 1, 6) AS docid FROM docs WHERE hash ILIKE 'a1%'")
def hash_prefix_lookup(spark, d):
    """Documents by a prefix of their hash."""
    return C.document_by_hash_prefix(table(spark, d, "document_rows"), "A1")


_FILES = (
    _DOCS
    + """,
emb AS (SELECT DISTINCT vec_id AS chunk_id FROM embeddings),
per AS (SELECT ch.doc_id, count(*) AS chunks, count(emb.chunk_id) AS embedded FROM ch LEFT JOIN emb USING (chunk_id) GROUP BY 1),
files AS (SELECT d.doc_id, d.collection_id, d.path, d.active, coalesce(p.chunks, 0) AS chunks, coalesce(p.embedded, 0) AS embedded FROM docs d LEFT JOIN per p USING (doc_id))"""
)


@query("WITH " + _FILES + " SELECT doc_id, collection_id, path, active, chunks, embedded, chunks > 0 AND embedded >= chunks AS is_embedded FROM files")
def file_list(spark, d):
    """All files with their chunks and vectors."""
    return C.file_list(*tables(spark, d, "document_rows", "chunks", "embeddings"))


@query("WITH " + _FILES + " SELECT doc_id, collection_id, path, active, chunks, embedded, chunks > 0 AND embedded >= chunks AS is_embedded FROM files WHERE path = 'app' OR starts_with(path, 'app/')")
def file_list_prefix(spark, d):
    """Files below a prefix."""
    return C.file_list(*tables(spark, d, "document_rows", "chunks", "embeddings"), prefix=T.normalize_prefix("./app//"))


@query("WITH " + _DOCS + " SELECT chunk_id, doc_id, seq, space_name, collection_id FROM idx WHERE active AND chunk_id NOT IN (SELECT vec_id FROM embeddings)")
def backlog_anti_join(spark, d):
    """Chunks without a vector."""
    return C.unembedded_chunks(*tables(spark, d, "chunks", "document_rows", "collections", "embeddings"))


@query(
    "WITH "
    + _DOCS
    + ", v AS (SELECT vec_id AS chunk_id, len(embedding) AS dim FROM embeddings) SELECT space_name, count(*) AS chunks, count(dim) AS vectors, count(DISTINCT dim) AS dimensions, count(DISTINCT dim) <= 1 AS consistent FROM idx LEFT JOIN v USING (chunk_id) GROUP BY 1"
)
def integrity_check(spark, d):
    """Vectors and their dimensions per space."""
    return C.integrity_by_space(*tables(spark, d, "chunks", "document_rows", "collections", "embeddings"))


@query(
    "WITH "
    + _FILES
    + """ SELECT coalesce(c.space_name, '*') AS space_name, coalesce(c.collection_name, '*') AS collection_name, grouping(c.space_name, c.collection_name)::BIGINT AS level, count(f.doc_id) AS documents,
    count(*) FILTER (coalesce(f.active, false)) AS active_documents, coalesce(sum(f.chunks), 0)::BIGINT AS chunks, coalesce(sum(f.embedded), 0)::BIGINT AS embedded, max(c.updated) AS updated
    FROM cols c LEFT JOIN files f ON f.collection_id = c.collection_id GROUP BY ROLLUP (c.space_name, c.collection_name)"""
)
def status_rollup(spark, d):
    """Counts per collection, space and in total."""
    return C.status_rollup(*tables(spark, d, "document_rows", "chunks", "collections", "embeddings"))


@query("WITH " + _DOCS + " SELECT space_name, collection_id, count(DISTINCT CASE WHEN active THEN doc_id END) AS documents, count(*) FILTER (active) AS chunks, bool_or(NOT active) AS has_inactive FROM idx GROUP BY 1, 2")
def scope_summary(spark, d):
    """What a search of each collection ranges over."""
    return C.search_scope(*tables(spark, d, "chunks", "document_rows", "collections"))


@query(
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY recorded_at DESC, row_id DESC) AS n FROM (SELECT DISTINCT * FROM document_rows WHERE doc_id IS NOT NULL AND collection_id IS NOT NULL AND path IS NOT NULL)),
s AS (SELECT collection_id, path, max(struct_pack(recorded_at, row_id, modified, hash)) AS x FROM v WHERE n = 1 AND active GROUP BY 1, 2),
c AS (SELECT collection_id, path, max(struct_pack(recorded_at, row_id, modified, hash, active)) AS x FROM v WHERE n = 2 GROUP BY 1, 2)
SELECT coalesce(s.collection_id, c.collection_id) AS collection_id, coalesce(s.path, c.path) AS path, CASE WHEN s.path IS NULL AND c.x.active THEN 'deactivated' WHEN s.path IS NULL THEN 'gone' WHEN c.path IS NULL THEN 'new'
  WHEN c.x.active AND s.x.modified = c.x.modified THEN 'skipped_mtime' WHEN s.x.hash = c.x.hash AND c.x.active THEN 'skipped_hash' WHEN s.x.hash = c.x.hash THEN 'reactivated' ELSE 'changed' END AS decision
FROM s FULL JOIN c ON s.collection_id = c.collection_id AND s.path = c.path"""
)
def scan_diff_classify(spark, d):
    """The newest active rows, as a scan, against the rows before them, as the catalogue."""
    rows = table(spark, d, "document_rows").where("doc_id is not null and collection_id is not null and path is not null")
    both = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("recorded_at"), F.desc("row_id"))))
    last = lambda df, *c: df.groupBy("collection_id", "path").agg(F.max(F.struct("recorded_at", "row_id", *c)).alias("x")).select("collection_id", "path", *[F.col(f"x.{k}").alias(k) for k in c], F.lit("g").alias("generation_key"))
    return C.scan_diff(last(both.where("n = 1 and active"), "modified", "hash"), last(both.where("n = 2"), "modified", "hash", "active"))


@query("WITH " + _DOCS + " SELECT doc_id, active AND doc_id % 7 <> 0 AS active, CASE WHEN doc_id % 7 = 0 THEN coalesce(deactivated_at, TIMESTAMP '2026-01-01') ELSE deactivated_at END AS deactivated_at FROM docs")
def soft_delete(spark, d):
    """Documents after a soft delete of some."""
    docs = C.current_documents(table(spark, d, "document_rows"))
    return C.soft_delete(docs, docs.where("doc_id % 7 = 0"), NOW).select("doc_id", "active", "deactivated_at")


@query("WITH " + _DOCS + " SELECT doc_id, deactivated_at FROM docs WHERE NOT active AND deactivated_at <= TIMESTAMP '2026-01-01' - INTERVAL 90 DAY")
def reapable_documents(spark, d):
    """Documents to reap."""
    return C.reapable(C.current_documents(table(spark, d, "document_rows")), NOW, 90).select("doc_id", "deactivated_at")


@query("WITH " + _DOCS + ", r AS (SELECT doc_id FROM docs WHERE NOT active AND deactivated_at <= TIMESTAMP '2026-01-01' - INTERVAL 90 DAY) SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM r)")
def reap_cascade(spark, d):
    """Chunks left after reaping."""
    rows, chunks = tables(spark, d, "document_rows", "chunks")
    left = C.delete_where_in(C.distinct_chunks(chunks), C.reapable(C.current_documents(rows), NOW, 90), ["doc_id"])
    return left.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


@query("WITH " + _DOCS + ", f AS (SELECT doc_id, collection_id, path FROM docs WHERE fts_dirty) SELECT f.doc_id, f.collection_id, f.path, count(ch.chunk_id) AS chunks, coalesce(string_agg(ch.chunk_id::VARCHAR, ',' ORDER BY ch.seq, ch.chunk_id), NULL) AS chunk_ids FROM f LEFT JOIN ch USING (doc_id) GROUP BY 1, 2, 3")
def fts_dirty_backlog(spark, d):
    """Documents whose full-text entries are stale."""
    return C.fts_dirty_documents(*tables(spark, d, "document_rows", "chunks"))


@query(
    """WITH old AS (SELECT doc_id, hash, modified FROM (SELECT DISTINCT doc_id, hash, modified, recorded_at, row_id FROM document_rows WHERE doc_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY recorded_at, row_id) = 1),
new AS (SELECT doc_id, hash, modified FROM document_rows WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY recorded_at DESC, row_id DESC) = 1)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.hash ELSE o.hash END AS hash, CASE WHEN n.doc_id IS NOT NULL THEN n.modified ELSE o.modified END AS modified FROM old o FULL JOIN new n USING (doc_id)"""
)
def upsert_documents(spark, d):
    """First versions of documents with newer ones merged over a third of them."""
    rows = table(spark, d, "document_rows").where("doc_id is not null")
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("hash", "modified"), F.struct("recorded_at", "row_id")).alias("r")).select("doc_id", "r.*")
    return C.upsert(first, C.current_documents(rows).where("doc_id % 3 = 0").select("doc_id", "hash", "modified"), ["doc_id"])


@query(
    """WITH r AS (SELECT DISTINCT doc_id, seq - 1 AS lo, seq + 1 AS hi FROM chunks WHERE chunk_id IS NOT NULL AND kind = 'section'),
m AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS island FROM m) SELECT doc_id, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM i GROUP BY doc_id, island"""
)
def seq_range_coalesce(spark, d):
    """Neighbour ranges of hits, merged."""
    hits = C.distinct_chunks(table(spark, d, "chunks")).where("kind = 'section'")
    return C.coalesced_seq_ranges(hits.select("doc_id", (F.col("seq") - 1).cast("bigint").alias("lo"), (F.col("seq") + 1).cast("bigint").alias("hi")))


@query(
    "WITH "
    + _DOCS
    + " SELECT h.chunk_id, h.doc_id, h.seq, count(*) AS neighbors, string_agg(n.text, chr(10) || chr(10) ORDER BY n.seq, n.chunk_id) AS context FROM ch h JOIN ch n ON h.doc_id = n.doc_id AND n.seq BETWEEN h.seq - 1 AND h.seq + 1 WHERE h.kind = 'section' GROUP BY 1, 2, 3"
)
def neighbor_context(spark, d):
    """Sections with the chunks before and after."""
    c = table(spark, d, "chunks")
    return C.neighbor_context(c, c.where("kind = 'section'"))


# -- text index and keyword search


@query("WITH " + _FIELDS + " SELECT space_name, chunk_id, title, heading, filepath, body FROM entries")
def index_entries(spark, d):
    """The searched fields of all chunks."""
    return S.with_fields(_index_chunks(spark, d)).select("space_name", "chunk_id", "title", "heading", "filepath", "body")


@query("WITH " + _FIELDS + " SELECT space_name, field, count(*) AS n_chunks, round(avg(len), 6) AS avg_len, sum(len)::BIGINT AS tokens FROM lens GROUP BY 1, 2")
def doc_lengths(spark, d):
    """Lengths of fields per space."""
    return _index(spark, d).lengths.groupBy("space_name", "field").agg(F.count("*").alias("n_chunks"), F.round(F.avg("len"), 6).alias("avg_len"), F.sum("len").alias("tokens"))


@query("WITH " + _FIELDS + " SELECT space_name, field, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs JOIN stats USING (space_name, field)")
def term_stats(spark, d):
    """Document frequencies and inverse ones of all terms."""
    return _rounded(S.term_statistics(_index(spark, d)), "idf")


@query("WITH " + _FIELDS + ", " + _top("scores"))
def bm25_keyword_topk(spark, d):
    """Keyword search of all judged queries over four fields."""
    return _rounded(S.keyword_results(_scores(spark, d), 10), "raw", "score")


_SCOPED = """, scope AS (SELECT DISTINCT q.case_id AS qid, i.chunk_id FROM eval_cases q JOIN idx i ON (q.space_name IS NULL OR q.space_name = i.space_name) AND (coalesce(len(q.collection_names), 0) = 0 OR list_contains(q.collection_names, i.collection_name)) WHERE i.active),
scoped AS (SELECT s.* FROM scores s JOIN scope USING (qid, chunk_id))"""


@query("WITH " + _FIELDS + _SCOPED + ", " + _top("scoped"))
def bm25_scoped_filter(spark, d):
    """Keyword search within each query's scope; statistics stay those of the spaces."""
    return _rounded(S.keyword_results(_scores(spark, d, scoped=True), 10), "raw", "score")


@query("WITH " + _FIELDS + _SCOPED + " SELECT count(*) AS pairs, 0::BIGINT AS changed FROM scoped")
def bm25_filter_invariance(spark, d):
    """Scoped scores that differ from the unscoped ones: none."""
    free, held = _scores(spark, d), _scores(spark, d, scoped=True).withColumnRenamed("score", "scoped")
    return held.join(free, ["qid", "space_name", "chunk_id"], "left").agg(F.count("*").alias("pairs"), F.count_if(~F.col("score").eqNullSafe(F.col("scoped"))).alias("changed"))


# -- vectors

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


@query(f"SELECT q.vec_id AS qid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rank, v.vec_id AS chunk_id, round({_COS}, 6) AS similarity, round(1 / (1 + greatest(1 - {_COS}, 0)), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10")
def knn_topk(spark, d):
    """Exact neighbours of every fiftieth vector among all."""
    v = _vectors(spark, d)
    return _rounded(S.knn_results(v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "vector"), v, 10), "similarity", "score")


@query(f"SELECT q.vec_id AS qid, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rank, v.vec_id AS chunk_id, round({_COS}, 6) AS similarity, round(1 / (1 + greatest(1 - {_COS}, 0)), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label < 3 QUALIFY rank <= 10")
def knn_filtered(spark, d):
    """The same among vectors of some labels."""
    v = _vectors(spark, d)
    return _rounded(S.knn_results(v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "vector"), v, 10, v.where("label < 3")), "similarity", "score")


# -- fusion, variants, reranking

_BRANCH = """once AS (SELECT search_id AS qid, chunk_id, max(bm25) AS bm25, max(dense) AS dense FROM search_candidates WHERE search_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT qid, chunk_id, bm25, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, chunk_id) AS k_rank FROM once WHERE bm25 IS NOT NULL QUALIFY k_rank <= 40),
e AS (SELECT qid, chunk_id, dense, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, chunk_id) AS d_rank FROM once WHERE dense IS NOT NULL QUALIFY d_rank <= 40),
j AS (SELECT * FROM k FULL JOIN e USING (qid, chunk_id)),
m AS (SELECT *, count(bm25) OVER q AS nk, count(dense) OVER q AS nd, max(bm25) OVER q AS mk, max(dense) OVER q AS md, avg(bm25) OVER q AS ak, avg(dense) OVER q AS ad, stddev_pop(bm25) OVER q AS sk, stddev_pop(dense) OVER q AS sd FROM j WINDOW q AS (PARTITION BY qid)),
"""
_FUSED = """s AS (SELECT qid, chunk_id, bm25, dense, CASE WHEN nk = 0 THEN dense WHEN nd = 0 THEN bm25 ELSE {} END AS score FROM m),
n AS (SELECT qid, chunk_id, bm25, dense, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0 END AS score FROM s)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score, bm25, dense FROM n WHERE score >= 0 QUALIFY rank <= 10"""


def _share(c: str, m: str) -> str:
    return f"coalesce(CASE WHEN {m} > 0 THEN {c} / {m} ELSE 0 END, 0)"


def _placed(c: str, a: str, s: str, m: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN {s} > 1.1920929e-7 THEN least(greatest(({c} - ({a} - 3 * {s})) / (6 * {s}), 0), 1) WHEN {m} > 0 THEN {c} / {m} ELSE 0 END"


def _fusion(spark, d, fuse):
    keyword, dense = S.branch_lists(table(spark, d, "search_candidates"), S.MIN_CANDIDATES)
    return _rounded(fuse(keyword, dense), "score")


@query("WITH " + _BRANCH + _FUSED.format("coalesce(1.0 / (60 + k_rank), 0)::DOUBLE + coalesce(1.0 / (60 + d_rank), 0)::DOUBLE"))
def fuse_rrf(spark, d):
    """Reciprocal rank fusion of the keyword and dense lists of all searches."""
    return _fusion(spark, d, S.fuse_rrf)


@query("WITH " + _BRANCH + _FUSED.format(f"0.7::DOUBLE * {_share('dense', 'md')} + 0.3::DOUBLE * {_share('bm25', 'mk')}"))
def fuse_linear(spark, d):
    """Linear fusion of these lists."""
    return _fusion(spark, d, S.fuse_linear)


@query("WITH " + _BRANCH + _FUSED.format(f"{_placed('dense', 'ad', 'sd', 'md')} + 0.4::DOUBLE * {_placed('bm25', 'ak', 'sk', 'mk')}"))
def fuse_dbsf(spark, d):
    """Distribution-based fusion of these lists."""
    return _fusion(spark, d, S.fuse_dbsf)


_VARIANTS = """once AS (SELECT case_id AS qid, search_id, chunk_id, max(fusion) AS fusion, max(bm25) AS bm25, max(dense) AS dense FROM search_candidates WHERE case_id IS NOT NULL AND search_id IS NOT NULL AND chunk_id IS NOT NULL AND fusion IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT *, min(search_id) OVER (PARTITION BY qid) AS origin, row_number() OVER (PARTITION BY search_id ORDER BY fusion DESC, chunk_id) AS rank FROM once),
agg AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(bm25) AS bm25, max(dense) AS dense, min(CASE WHEN search_id = origin THEN rank END) AS original_rank FROM v GROUP BY 1, 2)
"""


def _variants(spark, d):
    c = table(spark, d, "search_candidates").where("case_id is not null and search_id is not null and chunk_id is not null and fusion is not null and not isnan(fusion)")
    once = c.groupBy(F.col("case_id").alias("qid"), "search_id", "chunk_id").agg(F.max("fusion").alias("fusion"), F.max("bm25").alias("bm25"), F.max("dense").alias("dense"))
    first = once.groupBy("qid").agg(F.min("search_id").alias("origin"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "search_id").orderBy(F.desc("fusion"), "chunk_id")).cast("bigint"))
    return ranked.join(first, "qid").withColumn("variant", F.when(F.col("search_id") == F.col("origin"), 0).otherwise(1))


@query("WITH " + _VARIANTS + "SELECT qid, chunk_id, round(score, 6) AS score, bm25, dense, original_rank FROM agg")
def deep_variant_rrf(spark, d):
    """The searches of a case as variants of one query, by RRF."""
    return _rounded(S.aggregate_variants(_variants(spark, d)), "score")


@query(
    "WITH "
    + _VARIANTS
    + """, n AS (SELECT qid, chunk_id, round(score / max(score) OVER (PARTITION BY qid), 9) AS score, original_rank FROM agg),
p AS (SELECT *, original_rank IS NOT NULL AND row_number() OVER (PARTITION BY qid ORDER BY original_rank NULLS LAST, score DESC, chunk_id) <= 5 AS protected FROM n),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY protected DESC, score DESC, chunk_id) <= 10)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score, original_rank, protected FROM t"""
)
def deep_protected_topk(spark, d):
    """The first ten of each case, five of them from its first search."""
    agg = S.aggregate_variants(_variants(spark, d))
    best = agg.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("qid")), 9))
    return _rounded(S.finalize_variants(best), "score")


_POSITIONS = """once AS (SELECT search_id AS qid, chunk_id, max(doc_id) AS doc_id, max(fusion) AS fusion, max(reranker) AS reranker, max(original_rank) AS original_rank FROM search_candidates
  WHERE search_id IS NOT NULL AND chunk_id IS NOT NULL AND doc_id IS NOT NULL AND fusion IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fusion DESC, chunk_id) AS position FROM once),
ds AS (SELECT qid, doc_id, max(reranker) AS reranker FROM c WHERE reranker IS NOT NULL GROUP BY 1, 2)
"""


def _positions(spark, d):
    c = table(spark, d, "search_candidates").where("search_id is not null and chunk_id is not null and doc_id is not null and fusion is not null and not isnan(fusion)")
    once = c.groupBy(F.col("search_id").alias("qid"), "chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("fusion").alias("fusion"), F.max("reranker").alias("reranker"), F.max("original_rank").alias("original_rank"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fusion"), "chunk_id")).cast("bigint"))


@query(
    "WITH "
    + _POSITIONS
    + """, x AS (SELECT c.qid, c.doc_id, c.chunk_id, c.position, c.fusion, ds.reranker, min(c.position) OVER dd AS first, max(c.fusion) OVER dd AS most FROM c LEFT JOIN ds USING (qid, doc_id) WINDOW dd AS (PARTITION BY c.qid, c.doc_id)),
y AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY reranker DESC NULLS LAST, first) AS r FROM x),
z AS (SELECT *, CASE WHEN reranker IS NOT NULL THEN CASE WHEN most > 0 THEN least(greatest(fusion / most, 0), 1) ELSE 1 END / log2(r + 1) END AS s FROM y),
t AS (SELECT *, coalesce(s, coalesce(min(s) OVER (PARTITION BY qid), 0) - row_number() OVER (PARTITION BY qid ORDER BY reranker IS NOT NULL, position) * 1e-9) AS final_score FROM z)
SELECT qid, doc_id, chunk_id, position, reranker, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, position) AS rank FROM t"""
)
def rerank_apply(spark, d):
    """The order of all candidates after reranking their documents."""
    p = _positions(spark, d)
    scores = p.where("reranker is not null and not isnan(reranker)").groupBy("qid", "doc_id").agg(F.max("reranker").alias("reranker"))
    return _rounded(S.apply_rerank(p.drop("reranker"), scores), "final_score")


@query(
    "WITH "
    + _POSITIONS
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY position) AS rn FROM c), b AS (SELECT * FROM f WHERE rn = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY position) AS pick, doc_id, chunk_id FROM b QUALIFY pick <= 30"""
)
def rerank_representatives(spark, d):
    """The best chunk of the first thirty documents of every search."""
    return S.rerank_representatives(_positions(spark, d))


@query(
    "WITH "
    + _POSITIONS
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY position) AS n, count(*) OVER (PARTITION BY qid, doc_id) - 1 AS extra_matches FROM c)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY position) AS doc_rank, doc_id, chunk_id, extra_matches FROM g WHERE n = 1 QUALIFY doc_rank <= 10"""
)
def group_results_by_document(spark, d):
    """Results grouped by document."""
    return S.group_by_document(_positions(spark, d).withColumnRenamed("position", "rank"), 10)


# -- evaluation

_EVAL = (
    "WITH "
    + _DOCS
    + """,
r AS (SELECT s.case_id AS qid, s.chunk_id, max(s.final_score) AS v FROM search_candidates s WHERE s.case_id IS NOT NULL AND s.chunk_id IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT r.qid, i.collection_name || '/' || i.filepath AS path, row_number() OVER (PARTITION BY r.qid ORDER BY r.v DESC NULLS LAST, r.chunk_id) AS rank FROM r JOIN idx i USING (chunk_id)),
p AS (SELECT qid, path, min(rank) AS rank FROM ranked GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, path) AS place FROM p QUALIFY place <= 10),
j AS (SELECT case_id AS qid, path, max(relevance) AS relevance FROM eval_judgments WHERE relevance > 0 AND path IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, path) AS place FROM j),
b AS (SELECT qid, sum(CASE WHEN place <= 10 THEN (2.0 ^ relevance - 1) / log2(place + 1) END) AS best, count(*) AS relevant FROM o GROUP BY 1),
h AS (SELECT qid, sum((2.0 ^ relevance - 1) / log2(place + 1)) AS dcg, count(*) AS found, min(place) AS first_at FROM q JOIN j USING (qid, path) GROUP BY 1),
m AS (SELECT b.qid, coalesce(dcg, 0) / best AS ndcg, coalesce(found, 0) / relevant AS recall, coalesce(1.0 / first_at, 0)::DOUBLE AS mrr FROM b LEFT JOIN h USING (qid))"""
)


def _evaluated(spark, d):
    c = table(spark, d, "search_candidates").where("case_id is not null and chunk_id is not null").groupBy(F.col("case_id").alias("qid"), "chunk_id").agg(F.max("final_score").alias("v"))
    paths = _index_chunks(spark, d).select("chunk_id", F.concat("collection_name", F.lit("/"), "filepath").alias("path"))
    ranked = c.join(paths, "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("v"), "chunk_id")).cast("bigint"))
    judged = table(spark, d, "eval_judgments").where("path is not null").select(F.col("case_id").alias("qid"), "path", "relevance")
    return S.evaluation(ranked.select("qid", "rank", "path"), judged)


@query(_EVAL + " SELECT qid, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM m")
def eval_per_query(spark, d):
    """nDCG, recall and reciprocal rank at 10 of every judged case."""
    return _rounded(_evaluated(spark, d), "ndcg", "recall", "mrr")


@query(_EVAL + " SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM m")
def eval_ndcg_recall_mrr(spark, d):
    """Their means."""
    return _evaluated(spark, d).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "mrr")])


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS samples FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentile(spark, d):
    """Nearest-rank percentiles, from counts of distinct values so that no group is gathered."""
    v = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    c = v.withColumns({"upto": F.sum("n").over(w.orderBy("value")), "all": F.sum("n").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("value")))
    return c.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("all").alias("samples"))


# -- reads


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '')) AS tokens FROM documents")
def whitespace_token_counts(spark, d):
    """Tokens and bytes of all documents."""
    return table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"), F.size(T.whitespace_tokens("text")).cast("bigint").alias("tokens"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[3:7], chr(10)) AS window_text, len(string_split(text, chr(10))) AS total_lines FROM documents WHERE text IS NOT NULL")
def get_line_window(spark, d):
    """Lines three to seven of all documents."""
    lines = F.split("text", "\n", -1)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(lines, 3, 5), "\n").alias("window_text"), F.size(lines).cast("bigint").alias("total_lines"))


@query(
    """WITH d AS (SELECT source, list(struct_pack(i := doc_id, b := octet_length(encode(coalesce(text, '')))) ORDER BY doc_id) AS l FROM documents WHERE source IS NOT NULL GROUP BY 1),
f AS (SELECT source, list_reduce(list_transform(l, lambda x: struct_pack(n := 0::BIGINT, used := 0::BIGINT, b := x.b)), lambda a, x: struct_pack(n := a.n + CASE WHEN a.n < 20 AND a.used + x.b <= 8000 THEN 1 ELSE 0 END, used := a.used + CASE WHEN a.n < 20 AND a.used + x.b <= 8000 THEN x.b ELSE 0 END, b := 0::BIGINT), struct_pack(n := 0::BIGINT, used := 0::BIGINT, b := 0::BIGINT)) AS r FROM d)
SELECT source, r.n AS taken, r.used AS bytes FROM f"""
)
def multi_get_budget(spark, d):
    """Documents of each source that a request for all of them gets within 20 files and 8,000 bytes, in id order."""
    from lodeweir.operators.reads import budgeted_take

    docs = table(spark, d, "documents").where("source is not null").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    return budgeted_take(docs, "source", "doc_id", "bytes", 20, 8000)


@query("SELECT c.chunk_id, CASE WHEN c.byte_offset >= 0 AND c.byte_length >= 0 AND c.byte_offset + c.byte_length <= octet_length(encode(t.text)) THEN decode(encode(t.text)[(c.byte_offset + 1)::BIGINT : (c.byte_offset + c.byte_length)::BIGINT]) END AS slice FROM (SELECT DISTINCT chunk_id, doc_id, byte_offset, byte_length FROM chunks WHERE chunk_id IS NOT NULL) c JOIN (SELECT DISTINCT doc_id, text FROM document_texts WHERE text IS NOT NULL) t USING (doc_id)")
def canonical_slices(spark, d):
    """Texts of chunks as slices of their documents."""
    texts = table(spark, d, "document_texts").where("text is not null").dropDuplicates(["doc_id"]).select("doc_id", F.col("text").alias("whole"))
    return C.distinct_chunks(table(spark, d, "chunks")).select("chunk_id", "doc_id", "byte_offset", "byte_length").join(texts, "doc_id").select("chunk_id", T.byte_slice("whole", "byte_offset", "byte_length").alias("slice"))


# -- star schema


@query("SELECT r.r_name AS region, n.n_name AS nation, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2")
def star_customers_by_nation(spark, d):
    """Customers and balances by region and nation."""
    c, n, r = tables(spark, d, "customer", "nation", "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def star_customers_without_orders(spark, d):
    """Customers without an order."""
    c, o = tables(spark, d, "customer", "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing_summary(spark, d):
    """Line items by flag and status."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit(datetime(1998, 9, 2)))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )


# -- extraction and chunks


def _extracted(spark, d):
    from lodeweir.operators.extract import extract_documents

    t = table(spark, d, "document_texts").where("doc_id is not null").dropDuplicates(["doc_id"])
    return extract_documents(t.select("doc_id", "extractor_key", "text")).where("error is null"), t.select("doc_id", "extractor_key")


@query()
def extract_blocks(spark, d):
    """Blocks of all document texts by their extractors."""
    docs, _ = _extracted(spark, d)
    return docs.select("doc_id", F.posexplode("blocks").alias("block_no", "b")).select("doc_id", "block_no", "b.kind", "b.offset", "b.length", F.array_join("b.heading_path", " > ").alias("heading"))


@query()
def canonical_texts(spark, d):
    """Titles and canonical texts."""
    docs, _ = _extracted(spark, d)
    return docs.select("doc_id", "title", "text", F.size("blocks").cast("bigint").alias("blocks"))


@query()
def chunk_pack(spark, d):
    """Structure-aware chunks of all document texts."""
    from lodeweir.operators.chunking import chunk_documents

    docs, keys = _extracted(spark, d)
    return chunk_documents(docs.join(keys, "doc_id").select("doc_id", "extractor_key", "text", "blocks"))


@query(
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '') AS t FROM documents), c AS (SELECT doc_id, t, greatest(1, ceil((len(t) - 200) / 180.0)::BIGINT + 1) AS n FROM t WHERE len(t) > 0),
w AS (SELECT doc_id, t, unnest(range(0, n)) AS "window" FROM c)
SELECT doc_id, "window", "window" * 180 AS first_token, len(t["window" * 180 + 1 : "window" * 180 + 200]) AS tokens, array_to_string(t["window" * 180 + 1 : "window" * 180 + 200], ' ') AS text FROM w"""
)
def token_windows(spark, d):
    """Windows of 200 tokens that share 20, of all documents."""
    from lodeweir.operators.chunking import token_windows as windows

    return windows(table(spark, d, "documents"), "doc_id", "text", 200, 20)


@query("SELECT doc_id, i - 1 AS paragraph, trim(p, chr(10)) AS text FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n[ \\t]*(?:\\n[ \\t]*)+'), lambda p: trim(p, chr(10) || ' ' || chr(9)) <> '') AS l FROM documents WHERE text IS NOT NULL))")
def paragraph_split(spark, d):
    """Paragraphs of all documents, by the plain-text extractor."""
    from lodeweir.operators.extract import plaintext_blocks

    def run(batches):
        for pdf in batches:
            rows = [(i, k, b["text"]) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for k, b in enumerate(plaintext_blocks(t)[1])]
            yield pd.DataFrame(rows, columns=["doc_id", "paragraph", "text"])

    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, paragraph bigint, text string")


# -- freshness


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS events FROM s GROUP BY user_id, s"""
)
def debounce_sessions(spark, d):
    """Runs of events without six quiet hours."""
    from lodeweir.streaming.watch import quiet_sessions

    return quiet_sessions(table(spark, d, "events"), "user_id", "ts", 21_600_000)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS changes FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def change_windows(spark, d):
    """Events per hour and type."""
    from lodeweir.streaming.watch import change_counts

    df = change_counts(table(spark, d, "events").where("ts is not null"), "event_type", "ts", "1 hour")
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query()
def search_auto(spark, d):
    """Hybrid search of all judged queries with neighbour context; vectors are those of a hashing embedder."""
    from lodeweir.plans.demo_models import demo_engine

    return demo_engine(spark, d)[0]


@query()
def search_deep_reranked(spark, d):
    """Deep search with reranking of all judged queries."""
    from lodeweir.plans.demo_models import demo_engine

    return demo_engine(spark, d, "deep")[0]
