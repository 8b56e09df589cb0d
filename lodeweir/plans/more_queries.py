"""Further queries for catalogue lookups, parts of ranking, extraction and freshness, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweir.functions import text as T
from lodeweir.operators import catalog as C
from lodeweir.operators import extract as X
from lodeweir.operators import maintenance as M
from lodeweir.operators import search as S
from lodeweir.operators.stores import embedding_models
from lodeweir.plans.reference_queries import _BRANCH, _DOCS, _FIELDS, _FILES, _FUSED, _fusion, _index, _index_chunks, _queries, _rounded, query, tables
from lodeweir.session import table


# -- lookups


@query("WITH " + _DOCS + " SELECT doc_id, collection_id, path, hash, active FROM docs WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 50 = 0)")
def documents_by_ids(spark, d):
    """Current documents of a list of ids."""
    ids = table(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id")
    return C.documents_in(table(spark, d, "document_rows"), ids).select("doc_id", "collection_id", "path", "hash", "active")


@query("WITH " + _DOCS + " SELECT chunk_id, doc_id, seq, kind FROM ch WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def chunks_by_ids(spark, d):
    """Chunks of a list of ids."""
    ids = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("chunk_id"))
    return C.distinct_chunks(table(spark, d, "chunks")).join(ids.distinct(), "chunk_id", "left_semi").select("chunk_id", "doc_id", "seq", "kind")


@query("WITH " + _DOCS + " SELECT d.collection_id, d.path, d.doc_id FROM docs d JOIN (SELECT DISTINCT collection_id, path FROM docs WHERE path LIKE 'app/%') w ON w.collection_id = d.collection_id AND w.path = d.path")
def document_by_path(spark, d):
    """Documents by collection and path."""
    docs = C.current_documents(table(spark, d, "document_rows"))
    wanted = docs.where(F.col("path").startswith("app/")).select("collection_id", "path").distinct()
    return C.documents_at(docs, wanted).select("collection_id", "path", "doc_id")


_TEXTS = "t AS (SELECT doc_id, max(struct_pack(text, generation_key, extractor_key)) AS x FROM document_texts WHERE doc_id IS NOT NULL GROUP BY 1)"


@query("WITH " + _DOCS + ", " + _TEXTS + " SELECT d.doc_id, t.doc_id IS NOT NULL AS has_text, coalesce(octet_length(encode(t.x.text)), 0) AS bytes FROM docs d LEFT JOIN t USING (doc_id)")
def texts_for_documents(spark, d):
    """Texts of all current documents, missing ones marked."""
    docs, texts = C.current_documents(table(spark, d, "document_rows")), table(spark, d, "document_texts")
    return C.texts_for(docs.select("doc_id"), texts).select("doc_id", "has_text", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)).alias("bytes"))


@query("WITH " + _DOCS + ", " + _TEXTS + " SELECT doc_id FROM docs JOIN t USING (doc_id) WHERE x.generation_key <> ''")
def documents_with_generation(spark, d):
    """Documents that have a text of a known generation."""
    docs, texts = C.current_documents(table(spark, d, "document_rows")), table(spark, d, "document_texts")
    return C.texts_for(docs.select("doc_id"), texts).where("has_text and generation_key <> ''").select("doc_id")


@query("SELECT generation_key, extractor_key, count(DISTINCT doc_id) AS documents FROM document_texts WHERE doc_id IS NOT NULL GROUP BY 1, 2")
def generation_keys(spark, d):
    """Generations and extractors of texts."""
    return table(spark, d, "document_texts").where("doc_id is not null").groupBy("generation_key", "extractor_key").agg(F.count_distinct("doc_id").alias("documents"))


@query("WITH " + _DOCS + " SELECT DISTINCT i.space_name, 'label-' || (v.label % 3) AS model FROM embeddings v JOIN idx i ON i.chunk_id = v.vec_id")
def embedding_models_by_space(spark, d):
    """Models of each space's vectors; the labels of the vectors stand for models."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label-"), (F.col("label") % 3).cast("string")).alias("model"))
    return embedding_models(v.join(_index_chunks(spark, d).select("chunk_id", "space_name"), "chunk_id"))


@query("WITH " + _DOCS + " SELECT space_name, doc_id, seq, chunk_id, row_number() OVER (PARTITION BY space_name ORDER BY doc_id, seq, chunk_id) AS place FROM idx WHERE active")
def active_chunk_ids(spark, d):
    """Chunks in scope, in the order of their documents."""
    live = _index_chunks(spark, d).where("active").select("space_name", "doc_id", "seq", "chunk_id")
    return live.withColumn("place", F.row_number().over(Window.partitionBy("space_name").orderBy("doc_id", "seq", "chunk_id")).cast("bigint"))


@query("WITH " + _DOCS + " SELECT doc_id, path FROM docs WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def keyset_page(spark, d):
    """A page of documents behind a key; the page size is the feature."""
    return M.keyset_page(C.current_documents(table(spark, d, "document_rows")).select("doc_id", "path"), "doc_id", 100, 25)


@query("WITH " + _DOCS + " SELECT doc_id, '#' || substr(hash, 1, 6) AS docid, lower(substr('##' || upper(hash), 3)) AS normalized, string_split(path, '/')[-1] AS file_name FROM docs")
def short_docid(spark, d):
    """Short and normalised ids, and file names."""
    docs = C.current_documents(table(spark, d, "document_rows"))
    return docs.select("doc_id", T.short_docid("hash").alias("docid"), F.lower(T.normalized_docid(F.concat(F.lit("##"), F.upper("hash")))).alias("normalized"), T.file_title("path").alias("file_name"))


# -- counts


@query("WITH " + _FILES + " SELECT c.space_name, count(DISTINCT c.collection_id) AS collections, count(f.doc_id) AS documents, coalesce(sum(f.chunks), 0)::BIGINT AS chunks, coalesce(sum(f.embedded), 0)::BIGINT AS embedded FROM cols c LEFT JOIN files f USING (collection_id) GROUP BY 1")
def space_info(spark, d):
    """Counts of each space."""
    return C.space_info(*tables(spark, d, "document_rows", "chunks", "collections", "embeddings"))


@query("WITH " + _FILES + " SELECT c.collection_id, c.collection_name, count(f.doc_id) AS documents, count(*) FILTER (f.active) AS active_documents, coalesce(sum(f.chunks), 0)::BIGINT AS chunks, coalesce(sum(f.embedded), 0)::BIGINT AS embedded FROM cols c LEFT JOIN files f USING (collection_id) GROUP BY 1, 2")
def collection_info(spark, d):
    """Counts of each collection."""
    return C.collection_info(*tables(spark, d, "document_rows", "chunks", "collections", "embeddings"))


@query("WITH " + _FILES + " SELECT doc_id, chunks, embedded, chunks - embedded AS pending FROM files WHERE chunks > 0")
def embedded_counts(spark, d):
    """Chunks of each document with and without a vector."""
    f = C.file_list(*tables(spark, d, "document_rows", "chunks", "embeddings")).where("chunks > 0")
    return f.select("doc_id", "chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("pending"))


# -- ranking


@query("WITH " + _FIELDS + " SELECT space_name, term, max(round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6)) AS idf FROM dfs JOIN stats USING (space_name, field) WHERE field = 'body' GROUP BY 1, 2")
def idf_by_space(spark, d):
    """Inverse document frequencies of body terms in each space."""
    return _rounded(S.term_statistics(_index(spark, d)).where("field = 'body'").select("space_name", "term", "idf"), "idf")


@query("WITH " + _FIELDS + """, two AS (SELECT qt.qid, p.space_name, p.chunk_id, sum(CASE p.field WHEN 'title' THEN 3.0 ELSE 1.0 END::DOUBLE * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.len / s.avg_len))) AS score
    FROM post p JOIN dfs d USING (space_name, field, term) JOIN stats s USING (space_name, field) JOIN qt USING (term) WHERE p.field IN ('title', 'heading') GROUP BY 1, 2, 3)
    SELECT qid, space_name, chunk_id, round(score, 6) AS score FROM two""")
def bm25_multi_field(spark, d):
    """Keyword scores over titles and headings with boosts of their own."""
    return _rounded(S.bm25_scores(_queries(spark, d), _index(spark, d), boosts={"title": 3.0, "heading": 1.0}), "score")


@query("SELECT vec_id AS chunk_id, round(1 / (1 + greatest(embedding[1]::DOUBLE, 0)), 6) AS score FROM embeddings")
def distance_score(spark, d):
    """Scores of distances; a component of each vector stands for the distance."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.round(T.distance_score(F.col("embedding")[0].cast("double")), 6).alias("score"))


@query("WITH " + _BRANCH.replace("WHERE dense IS NOT NULL QUALIFY", "WHERE false QUALIFY") + _FUSED.format("0"))
def fuse_single_branch(spark, d):
    """Fusion where the dense list is empty: the keyword list alone, normalised."""
    return _fusion(spark, d, lambda keyword, dense: S.fuse_dbsf(keyword, dense.where(F.lit(False))))


_COSV = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH v AS (SELECT vec_id, vec_id // 4 AS qid, vec_id % 4 AS k, embedding FROM embeddings), s AS (SELECT qid FROM v GROUP BY 1 HAVING count(*) = 4),
p AS (SELECT a.qid, b.k, round({_COSV}, 9) AS sim FROM v a JOIN v b ON a.qid = b.qid AND a.k = 0 AND b.k > 0 JOIN s ON s.qid = a.qid),
n AS (SELECT a.qid, a.k AS k1, b.k AS k2, {_COSV} >= 0.98 AS near FROM v a JOIN v b ON a.qid = b.qid AND a.k > 0 AND b.k > 0 AND a.k <> b.k),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, k) AS r FROM p),
t AS (SELECT a.qid, a.k AS first, b.k AS second, c.k AS third, coalesce(x.near, false) AS n12, coalesce(y.near, false) AS n13 FROM o a JOIN o b ON a.qid = b.qid AND b.r = 2 JOIN o c ON a.qid = c.qid AND c.r = 3
  LEFT JOIN n x ON x.qid = a.qid AND x.k1 = a.k AND x.k2 = b.k LEFT JOIN n y ON y.qid = a.qid AND y.k1 = a.k AND y.k2 = c.k WHERE a.r = 1)
SELECT qid, first, CASE WHEN n12 AND NOT n13 THEN third ELSE second END AS second FROM t""")
def variant_selection(spark, d):
    """Of three rewrites of each query the two to run: the nearest, and the next that is no near-duplicate of it."""
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("qid"), (F.col("vec_id") % 4).alias("k"), "embedding")
    whole = v.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "embedding"))).alias("v")).where("size(v) = 4")

    def run(batches):
        for pdf in batches:
            chosen = [S.select_variants([[float(x) for x in e["embedding"]] for e in row], 2) for row in pdf["v"]]
            yield pdf[["qid"]].assign(first=[c[1] for c in chosen], second=[c[2] for c in chosen])

    return whole.mapInPandas(run, "qid bigint, first bigint, second bigint")


# -- extraction


def _of_kind(spark, d, kind: str) -> DataFrame:
    t = table(spark, d, "document_texts").where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max(F.struct("text", "extractor_key")).alias("x")).select("doc_id", "x.*")
    return X.extract_documents(t.where(F.col("extractor_key") == kind)).where("error is null")


@query("WITH " + _TEXTS + """, c AS (SELECT doc_id, x.text AS text FROM t WHERE x.text IS NOT NULL AND x.extractor_key = 'code') SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE 1 END::BIGINT AS blocks, text FROM c""")
def code_blocks(spark, d):
    """Code as one block each."""
    return _of_kind(spark, d, "code").select("doc_id", F.size("blocks").cast("bigint").alias("blocks"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@query()
def canonical_join(spark, d):
    """Canonical texts against their blocks: every block is the slice at its offset, and all of them, joined by empty lines, the text."""
    from lodeweir.plans.reference_queries import _extracted

    docs, _ = _extracted(spark, d)
    joined = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    whole = F.encode("text", "UTF-8")
    slices = F.forall("blocks", lambda b: whole.substr((b["offset"] + 1).cast("int"), b["length"].cast("int")) == F.encode(b["text"], "UTF-8"))
    return docs.select("doc_id", F.size("blocks").cast("bigint").alias("blocks"), (joined == F.col("text")).alias("joined"), slices.alias("slices"))


@query()
def html_blocks(spark, d):
    """Blocks of HTML texts."""
    return _of_kind(spark, d, "html").select("doc_id", F.posexplode("blocks").alias("block_no", "b")).select("doc_id", "block_no", "b.kind", "b.text")


@query()
def html_title(spark, d):
    """Titles of HTML texts."""
    return _of_kind(spark, d, "html").select("doc_id", "title")


@query()
def markdown_blocks(spark, d):
    """Blocks of Markdown texts with their headings."""
    return _of_kind(spark, d, "md").select("doc_id", F.posexplode("blocks").alias("block_no", "b")).select("doc_id", "block_no", "b.kind", "b.text", F.array_join("b.heading_path", " > ").alias("heading"))


@query("SELECT doc_id, text, kind, offset_bytes FROM (SELECT doc_id, 'Heading' AS kind, l[i] AS text, coalesce(list_sum(list_transform(l[1 : i - 1], lambda x: octet_length(encode(x)) + 1)), 0)::BIGINT AS offset_bytes, regexp_matches(l[i], '^#{1,6}[ \\t]+[^#\\s]') AS head, i FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '~~~'))) WHERE head")
def atx_headings(spark, d):
    """ATX headings of all documents without fences, as the Markdown extractor finds them at the beginning of lines."""
    docs = table(spark, d, "documents").where("text is not null and not contains(text, '```') and not contains(text, '~~~')").select("doc_id", F.lit("md").alias("extractor_key"), "text")

    def run(batches):
        for pdf in batches:
            rows = [(i, b["text"], b["kind"], b["offset"]) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for b in X.markdown_blocks(t)[1] if b["kind"] == "Heading" and b["text"].startswith("#") and "\n" not in b["text"]]
            yield pdf.iloc[:0][["doc_id"]].reindex(range(len(rows))).assign(doc_id=[r[0] for r in rows], text=[r[1] for r in rows], kind=[r[2] for r in rows], offset_bytes=[r[3] for r in rows])

    return docs.mapInPandas(run, "doc_id bigint, text string, kind string, offset_bytes bigint")


# -- freshness


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
f AS (SELECT user_id, n, t AS first, t AS last, 1::BIGINT AS events, 0::BIGINT AS session FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t >= least(f.last + 21600000000, f.first + 86400000000) THEN e.t ELSE f.first END, e.t,
    CASE WHEN e.t >= least(f.last + 21600000000, f.first + 86400000000) THEN 1 ELSE f.events + 1 END, CASE WHEN e.t >= least(f.last + 21600000000, f.first + 86400000000) THEN f.session + 1 ELSE f.session END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1),
g AS (SELECT user_id, session, max(first) AS first, max(last) AS last, max(events) AS events FROM f GROUP BY 1, 2)
SELECT user_id, make_timestamp(least(last + 21600000000, first + 86400000000)) AS due, make_timestamp(first) AS first_event, events FROM g""")
def keyword_due_with_cap(spark, d):
    """Refreshes after six quiet hours, or a day after the first change."""
    from lodeweir.streaming.watch import due_refreshes

    due = due_refreshes(table(spark, d, "events"), "user_id", "ts", 21_600_000, 86_400_000)
    return due.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("due", "first_event")})
