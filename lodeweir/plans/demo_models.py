"""Deterministic stand-ins for models, and an engine over the test tables."""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import pandas as pd
from pyspark.sql import functions as F

from lodeweir.operators import catalog as C
from lodeweir.operators import search as S
from lodeweir.operators.pending import source_files
from lodeweir.plans.engine import Engine, Models, SearchOptions
from lodeweir.session import shared_root, table

DIMENSIONS = 32


def embed(texts: pd.Series) -> pd.Series:
    """Signed hashed bags of words."""
    out = []
    for t in texts:
        v = [0.0] * DIMENSIONS
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % DIMENSIONS] += 1.0 if h & 1024 else -1.0
        out.append(v)
    return pd.Series(out)


def rerank(queries: pd.Series, documents: pd.Series) -> pd.Series:
    """Share of the query's words that the document has."""
    scores = []
    for q, d in zip(queries, documents, strict=True):
        words = set(re.findall(r"\w+", q.lower()))
        scores.append(len(words & set(re.findall(r"\w+", (d or "").lower()))) / max(1, len(words)))
    return pd.Series(scores)


def expand(query: str, most: int) -> list[str]:
    """A rewrite that asks for an explanation."""
    return ["explain " + query][:most]


def demo_index(spark, d: str):
    """(entries, text index, vectors) of the test tables; built once for each state of the tables and read from then on."""
    path = index_path(spark, d)
    index = S.TextIndex.read(spark, path)
    if index is None:
        C.index_chunks(*[table(spark, d, n) for n in ("chunks", "document_rows", "collections")]).write.mode("overwrite").parquet(f"{path}/entries")
        entries = spark.read.parquet(f"{path}/entries")
        as_vector = F.pandas_udf(lambda s: embed(s), "array<double>")
        entries.where("text is not null").select("chunk_id", "space_name", "collection_name", "active", as_vector("text").alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
        S.TextIndex.build(S.with_fields(entries)).write(path)
        index = S.TextIndex.read(spark, path)
    return spark.read.parquet(f"{path}/entries"), index, spark.read.parquet(f"{path}/vectors")


def index_path(spark, d: str) -> str:
    """Where the index of the tables in ``d`` lies: named by the files it was made from."""
    made_from = [source_files(spark, f"{d}/{n}.parquet") for n in ("chunks", "document_rows", "collections")]
    return f"{shared_root(spark)}/lodeweir/state/index-{hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()[:16]}"


def demo_engine(spark, d: str, mode: str = "auto"):
    """(results, engine) of all judged queries."""
    entries, index, vectors = demo_index(spark, d)
    engine = Engine(spark, entries, vectors, Models(embed, rerank, expand), index)
    cases = table(spark, d, "eval_cases").dropDuplicates(["case_id"]).select(F.col("case_id").alias("qid"), F.col("query_text").alias("text"), "space_name", F.col("collection_names").alias("collections"))
    return engine.search(cases, SearchOptions(mode=mode)), engine
