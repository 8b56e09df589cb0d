"""Reading documents: budgets of multi-document requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budgeted_take(docs: DataFrame, request: str, order: str, size: str, max_files: int, max_bytes: int) -> DataFrame:
    """(request, taken, bytes): greedy take in ``order`` within both budgets; a later document may fit where an earlier did not.

    The fold is sequential by nature; rows of a request stream through one task in batches, sorted, and nothing is kept
    but the two sums.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, used = None, 0, 0
        for pdf in batches:
            out = []
            for k, b in zip(pdf["k"], pdf["b"], strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, n, used))
                    key, n, used = k, 0, 0
                if n < max_files and used + b <= max_bytes:
                    n, used = n + 1, used + b
            yield pd.DataFrame(out, columns=["k", "taken", "bytes"])
        if key is not None:
            yield pd.DataFrame([(key, n, used)], columns=["k", "taken", "bytes"])

    rows = docs.select(F.col(request).cast("string").alias("k"), F.col(order).alias("o"), F.col(size).alias("b")).where("k is not null")
    # what exceeds the budget alone can never be taken
    rows = rows.where(F.col("b") <= max_bytes).repartition("k").sortWithinPartitions("k", "o")
    folded = rows.mapInPandas(fold, "k string, taken bigint, bytes bigint")
    everyone = docs.select(F.col(request).cast("string").alias("k")).where("k is not null").distinct()
    return everyone.join(folded, "k", "left").select(F.col("k").alias(request), F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
