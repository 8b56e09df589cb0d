"""Evaluation sets: JSON lines, relevance tables, corpora in BEIR layout, manifests."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; empty lines are skipped, a line that is no JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, corpus_id, relevance) of a tab-separated table with or without a header; zero scores are dropped."""
    raw = spark.read.option("sep", "\t").schema("query_id string, corpus_id string, score string").csv(path)
    df = raw.where(~F.lower(F.coalesce("score", F.lit(""))).isin("score", "relevance"))
    rel = F.expr("try_cast(score as int)")
    bad = df.where(rel.isNull() | (rel < 0) | (rel > 255) | F.col("query_id").isNull() | F.col("corpus_id").isNull()).head(1)
    if bad:
        raise ValueError(f"not a judgment: {bad[0].asDict()}")
    return df.select("query_id", "corpus_id", rel.alias("relevance")).where("relevance > 0")


def render_document(title: str = "title", text: str = "text") -> F.Column:
    """'# title', an empty line and the text; without a title the text alone."""
    body = F.concat(F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"))
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(F.lit("# "), F.trim(title), F.lit("\n\n"), body)).otherwise(body)


@dataclass
class BeirSet:
    """Documents (path, text), cases (query_id, query_text) and judgments (query_id, path, relevance)."""

    documents: DataFrame
    cases: DataFrame
    judgments: DataFrame


def import_beir(spark: SparkSession, folder: str, split: str = "test") -> BeirSet:
    """A corpus in BEIR layout; judgments of unknown or repeated (query, document) pairs are errors, queries without any are dropped."""
    corpus = read_jsonl(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string")
    queries = read_jsonl(spark, f"{folder}/queries.jsonl", "_id string, text string")
    qrels = read_qrels(spark, f"{folder}/qrels/{split}.tsv")
    for name, keys, column in (("documents", corpus, "corpus_id"), ("queries", queries, "query_id")):
        lost = qrels.join(keys.select(F.col("_id").alias(column)), column, "left_anti").head(1)
        if lost:
            raise ValueError(f"judgments refer to unknown {name}: {lost[0][column]}")
    twice = qrels.groupBy("query_id", "corpus_id").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"repeated judgment: {twice[0].asDict()}")
    judgments = qrels.select("query_id", F.concat("corpus_id", F.lit(".md")).alias("path"), "relevance")
    cases = queries.join(judgments.select(F.col("query_id").alias("_id")).distinct(), "_id", "left_semi").select(F.col("_id").alias("query_id"), F.col("text").alias("query_text"))
    return BeirSet(corpus.select(F.concat("_id", F.lit(".md")).alias("path"), render_document().alias("text")), cases, judgments)


def eval_cases(judgments: DataFrame) -> DataFrame:
    """(query_id, judgments): judgments of each query ordered by relevance and path."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("o"), "path", "relevance")))
    return judgments.groupBy("query_id").agg(F.transform(ordered, lambda j: F.struct(j["path"].alias("path"), j["relevance"].alias("relevance"))).alias("judgments"))


def load_manifest(text: str) -> list[dict]:
    """Cases of a TOML manifest: non-empty queries, collections once each, unique paths and at least one relevant one."""
    cases = []
    for k, case in enumerate(tomllib.loads(text).get("cases", [])):
        query = " ".join(str(case.get("query", "")).split())
        judgments = [(str(j["path"]).strip(), int(j.get("relevance", 1))) for j in case.get("judgments", [])]
        if not query:
            raise ValueError(f"case {k}: empty query")
        if len({p for p, _ in judgments}) < len(judgments):
            raise ValueError(f"case {k}: repeated path")
        if not any(r > 0 for _, r in judgments):
            raise ValueError(f"case {k}: no relevant path")
        cases.append({"query": query, "space": case.get("space"), "collections": list(dict.fromkeys(case.get("collections", []))), "judgments": judgments})
    if not cases:
        raise ValueError("a manifest needs at least one case")
    return cases
