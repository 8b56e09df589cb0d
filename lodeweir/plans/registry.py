"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweir.plans import core_queries, core_sql, more_queries, reference_queries  # noqa: F401, more_queries registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-field keyword search of all judged queries."""
    return reference_queries.bm25_keyword_topk(spark, sf_dir)


def queries() -> dict:
    """Core queries by name."""
    return {**core_queries.QUERIES, **reference_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the core queries."""
    return {**core_sql.SQL, **reference_queries.SQL}
