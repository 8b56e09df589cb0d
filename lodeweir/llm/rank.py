"""One ranking from several differently scaled scores (problem 4), by ideal points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the scores; equal, since the scores' own ranges must not decide.
WEIGHTS = {"bm25": 1.0, "dense": 1.0, "reranker": 1.0}
#: Groups of more rows are ranked by several tasks.
HOT_ROWS = 200_000
_BUCKETS, _TIES = 1024, 1 << 16


def split_rank(df: DataFrame, group: str, value: str, tie: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``rank`` from 1 per group, by ``value`` (in 0..1) descending, then ``tie`` (an integer) ascending.

    Where a count finds groups of more than ``hot_rows`` rows, ranks are prefix sums: rows are counted per value and
    block of ties, the counts are summed over value buckets, then inside them, so that no task sorts a whole group.
    """
    if not df.groupBy(group).count().where(F.col("count") > hot_rows).head(1):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie)).cast("bigint"))
    cell = [group, value, "_t"]
    marked = df.withColumn("_t", F.floor(F.col(tie) / _TIES))
    counts = marked.groupBy(*cell).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col(value) * _BUCKETS))
    above = Window.partitionBy(group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(group, "_b").agg(F.sum("_n").alias("_m")).withColumn("_over", F.coalesce(F.sum("_m").over(above), F.lit(0))).drop("_m")
    inside = Window.partitionBy(group, "_b").orderBy(F.desc(value), "_t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, [group, "_b"]).select(*cell, (F.col("_over") + F.col("_in")).alias("_off"))
    own = F.row_number().over(Window.partitionBy(*cell).orderBy(tie))
    return marked.join(offsets, cell).withColumn("rank", (F.col("_off") + own).cast("bigint")).drop("_t", "_off")


def _clean(c: str) -> Column:
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))


def ideal_point_ranking(candidates: DataFrame, weights: dict[str, float] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(search_id, chunk_id, closeness, rank): candidates by relative closeness to the ideal point of their search.

    Per search and score: values are winsorised at the quartiles less and plus one and a half interquartile ranges,
    moved so that the least is 0, and divided by their Euclidean norm; the ideal point has the greatest value of each
    score, the anti-ideal point the least. closeness = d- / (d- + d+) with weighted distances. Null, infinite and NaN
    scores are missing and say nothing: a candidate's distances run over the scores that it has. A score that is
    constant or missing throughout a search does not count; where none counts (or a search has one candidate),
    closeness is 0.5. Ties go to the lower chunk_id. Repeated rows count once; rows without search_id or
    chunk_id are left out. Statistics are aggregated before any join, with map-side partial aggregates, so a search
    with a third of all rows is no hot group; ranks see split_rank.
    """
    weights = weights or WEIGHTS
    names = list(weights)
    rows = candidates.where("search_id is not null and chunk_id is not null").groupBy("search_id", "chunk_id").agg(*[F.max(_clean(c)).alias(c) for c in names])
    quart = rows.groupBy("search_id").agg(*[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(f"q_{c}") for c in names])
    low = {c: F.col(f"q_{c}")[0] - 1.5 * (F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0]) for c in names}
    high = {c: F.col(f"q_{c}")[1] + 1.5 * (F.col(f"q_{c}")[1] - F.col(f"q_{c}")[0]) for c in names}
    clipped = rows.join(quart, "search_id").select("search_id", "chunk_id", *[F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), high[c]), low[c])).alias(c) for c in names])
    sums = [x for c in names for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}"))]
    stats = clipped.groupBy("search_id").agg(*sums)

    def norm(c: str) -> Column:
        """Norm of the moved values: sum (x - lo)^2."""
        return F.sqrt(F.greatest(F.col(f"ss_{c}") - 2 * F.col(f"lo_{c}") * F.col(f"s_{c}") + F.col(f"n_{c}") * F.col(f"lo_{c}") * F.col(f"lo_{c}"), F.lit(0.0)))

    norms = stats.select("search_id", *[F.col(f"{x}_{c}") for c in names for x in ("lo", "hi")], *[norm(c).alias(f"norm_{c}") for c in names])
    joined = clipped.join(norms, "search_id")
    live = {c: F.col(c).isNotNull() & F.coalesce((F.col(f"hi_{c}") > F.col(f"lo_{c}")) & (F.col(f"norm_{c}") > 0), F.lit(False)) for c in names}
    value = {c: F.coalesce(F.col(c) - F.col(f"lo_{c}"), F.lit(0.0)) / F.col(f"norm_{c}") for c in names}
    best = {c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.col(f"norm_{c}") for c in names}
    zero = F.lit(0.0)
    away = sum((F.when(live[c], weights[c] * F.pow(best[c] - value[c], F.lit(2.0))).otherwise(zero) for c in names), zero)
    near = sum((F.when(live[c], weights[c] * F.pow(value[c], F.lit(2.0))).otherwise(zero) for c in names), zero)
    total = F.sqrt(away) + F.sqrt(near)
    closeness = F.round(F.when(total > 0, F.sqrt(near) / total).otherwise(F.lit(0.5)), 9)
    return split_rank(joined.select("search_id", "chunk_id", closeness.alias("closeness")), "search_id", "closeness", "chunk_id", hot_rows)


def ranking_quality(candidates: DataFrame, grades: DataFrame, ranking: DataFrame, at: int = 10) -> DataFrame:
    """(ordering, searches, ndcg): mean nDCG of the ideal-point order and of the stored final_score, over graded searches.

    Gain 2^grade - 1, discount log2(rank + 1); searches without a positive grade are left out. Repeats count once.
    """
    graded = grades.where("search_id is not null and chunk_id is not null").groupBy("search_id", "chunk_id").agg(F.max("grade").alias("grade"))
    stored = candidates.where("search_id is not null and chunk_id is not null").groupBy("search_id", "chunk_id").agg(F.max("final_score").alias("v"))
    stored = stored.join(graded.select("search_id").distinct(), "search_id", "left_semi")
    w = Window.partitionBy("search_id")
    stored = stored.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("v"), "chunk_id")))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = graded.withColumn("rank", F.row_number().over(w.orderBy(F.desc("grade"), "chunk_id"))).where(F.col("rank") <= at)
    ideal = ideal.groupBy("search_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("idcg")).where("idcg > 0")

    def measured(order: DataFrame, name: str) -> DataFrame:
        hits = order.where(F.col("rank") <= at).join(graded, ["search_id", "chunk_id"]).groupBy("search_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
        both = ideal.join(hits, "search_id", "left")
        return both.agg(F.count("*").alias("searches"), F.round(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")), 6).alias("ndcg")).select(F.lit(name).alias("ordering"), "searches", "ndcg")

    return measured(ranking, "ideal_point").unionByName(measured(stored, "final_score"))
