"""Queries for problems 1 and 3 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweir.operators.pending import incremental_pending
from lodeweir.operators.references import orphan_references, orphans_by_month
from lodeweir.session import fresh_path, table


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_pending(spark, sf_dir).pending()


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*[table(spark, sf_dir, n) for n in ("document_rows", "collections", "eval_judgments", "eval_cases")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the next update has to process."""
    return _pending(spark, sf_dir).select("doc_id")


def p1_pending_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending documents by the month of their newest row."""
    return _pending(spark, sf_dir).groupBy(F.date_format("stamp", "yyyy-MM").alias("month")).agg(F.count("*").alias("documents"))


def p1_two_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates, the second after the rows and items of the last tenth of the time have arrived: documents that each
    has touched, and documents pending after it."""
    rows, runs, items = (table(spark, sf_dir, n) for n in ("document_rows", "update_runs", "update_items"))
    at = {t: F.unix_micros(F.col(t).cast("timestamp")) for t in ("recorded_at", "processed_at")}
    cut = int(rows.agg(F.max(at["recorded_at"]) - (F.max(at["recorded_at"]) - F.min(at["recorded_at"])).cast("bigint") / 10).first()[0])
    early = {t: F.coalesce(c <= cut, F.lit(True)) for t, c in at.items()}
    root = fresh_path(spark, "updates")
    folder, out = f"{root}/tables", []
    runs.write.parquet(f"{folder}/update_runs.parquet")
    for k in (1, 2):
        for name, df, t in (("document_rows", rows, "recorded_at"), ("update_items", items, "processed_at")):
            df.where(early[t] if k == 1 else ~early[t]).write.mode("append").parquet(f"{folder}/{name}.parquet")
        state = incremental_pending(spark, folder, f"{root}/state")
        out.append(state.pending().agg(F.lit(k).alias("update"), F.lit(int(state.state.properties()["touched"])).cast("bigint").alias("touched"), F.count("*").alias("pending")))
    return out[0].unionByName(out[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of both referring tables."""
    return _orphans(spark, sf_dir).select("ref_table", "ref_id")


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referring table and month."""
    return orphans_by_month(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_pending_by_month, p1_two_updates, p3_found, p3_orphans_by_month)}
