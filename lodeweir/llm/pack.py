"""Filling fixed-capacity containers (problem 8): bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweir.session import materialize

#: Open bins of a lane; tokens of the items of one lane; lanes whose last open bins are packed together.
OPEN_BINS, LANE_TOKENS, LANES_TOGETHER = 64, 4_000_000, 64
_LANE = 1 << 32


class BestFit:
    """At most ``open_bins`` open bins of ``capacity``; a bitset of the free amounts finds the fullest bin that fits.

    When an item fits nowhere and all bins are open, the fullest bin closes first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.n_open, self.n_bins = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_no = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return bin_no

    def add(self, size: int) -> int:
        """Bin of an item of ``size`` (1 to capacity); one that fills a bin alone gets it and closes none."""
        if size == self.capacity:
            self.n_bins += 1
            return self.n_bins - 1
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            free, bin_no = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(bin_no)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return bin_no

    def still_open(self) -> set[int]:
        """Bins that have free space and are not closed."""
        return {b for bins in self.by_free.values() for b in bins}


def _pack_lane(open_bins: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["_order", "item"], kind="stable")
        capacity = int(items["capacity"].iloc[0])
        fit = BestFit(capacity, open_bins)
        items["bin"] = [fit.add(int(s)) for s in items["tokens"]]
        items["bin_open"] = items["bin"].isin(fit.still_open())
        return items[["spec_id", "capacity", "lane", "item", "piece", "token_from", "tokens", "bin", "bin_open"]]

    return pack


_PACKED = "spec_id int, capacity bigint, lane bigint, item bigint, piece bigint, token_from bigint, tokens bigint, bin bigint, bin_open boolean"


def pack_documents(sizes: DataFrame, specs: DataFrame, open_bins: int = OPEN_BINS, lane_tokens: int = LANE_TOKENS, together: int = LANES_TOGETHER) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, token_from, tokens): every document in containers of every capacity.

    A document is split only where it alone exceeds the capacity: into full containers and a rest that is packed like
    any other item. Documents are dealt to lanes of about ``lane_tokens`` tokens by a hash of doc_id, so that lanes
    are even whatever source dominates; each lane is one online best-fit run in hash order. The bins still open when lanes
    end are items of a second run of the same kind over ``together`` lanes, which leaves at most ``open_bins`` underfull containers for so
    many lanes; with one lane it runs too. Documents without tokens (null or empty texts) get a null container. Specs with null or
    non-positive capacity are left out; repeated specs count once. Ids of containers are lane and counter, so none collide.
    """
    spec = specs.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.max(F.col("capacity_tokens").cast("bigint")).alias("capacity"))
    spec = F.broadcast(spec) if len(spec.head(101)) <= 100 else spec
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    lanes = max(1, -(-int(total) // lane_tokens))
    docs = sizes.select(F.col("doc_id").alias("item"), "tokens", F.xxhash64("doc_id").alias("_order")).crossJoin(spec)  # every document under every spec: stated as the task
    blank = docs.where("tokens = 0").select("spec_id", F.lit(None).cast("bigint").alias("container_id"), F.col("item").alias("doc_id"), F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("token_from"), "tokens")
    docs = docs.where("tokens > 0").withColumn("lane", F.pmod("_order", F.lit(lanes)))
    pieces = docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(tokens - 1) div capacity")))).withColumn("token_from", F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("token_from")))
    first = pieces.groupBy("spec_id", "lane").applyInPandas(_pack_lane(open_bins), _PACKED)
    first = materialize(first.withColumn("bin", F.col("lane") * _LANE + F.col("bin")), "packed")
    bins = first.where("bin_open").groupBy("spec_id", "capacity", "bin").agg(F.sum("tokens").alias("tokens"))
    second = bins.select(
        "spec_id", "capacity", F.expr(f"bin div {_LANE * together}").alias("lane"), F.col("bin").alias("item"), F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("token_from"), "tokens", F.xxhash64("bin").alias("_order")
    )
    moved = second.groupBy("spec_id", "lane").applyInPandas(_pack_lane(open_bins), _PACKED)
    moved = moved.select("spec_id", F.col("item").alias("bin"), ((F.lit(1 << 30) + F.col("lane")) * _LANE + F.col("bin")).alias("_moved"))
    placed = first.join(moved, ["spec_id", "bin"], "left").withColumn("container_id", F.coalesce("_moved", "bin"))
    return placed.select("spec_id", "container_id", F.col("item").alias("doc_id"), "piece", "token_from", "tokens").unionByName(blank)


def packing_faults(packed: DataFrame, sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, documents, missing, lost_tokens, overfull, split_needlessly): what a packing must keep, counted from its rows.

    ``documents`` are those that the packing holds; the other counts are 0 in a right packing.
    """
    spec = F.broadcast(specs.where("capacity_tokens > 0").groupBy("spec_id").agg(F.max(F.col("capacity_tokens").cast("bigint")).alias("capacity")))
    per_doc = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces")).join(spec, "spec_id")
    both = per_doc.join(sizes.select("doc_id", F.col("tokens").alias("size")), "doc_id")
    docs = both.groupBy("spec_id").agg(
        F.count("*").alias("documents"), F.sum(F.abs(F.col("size") - F.col("placed"))).alias("lost_tokens"), F.count_if(F.col("pieces") > F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1))).alias("split_needlessly")
    )
    full = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("load")).join(spec, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    return docs.join(full, "spec_id", "left").select("spec_id", "documents", (F.lit(sizes.count()) - F.col("documents")).alias("missing"), "lost_tokens", F.coalesce("overfull", F.lit(0)).alias("overfull"), "split_needlessly")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, items, containers, tokens, fill, least_containers): how full the containers of each spec are."""
    per = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    spec = specs.where("capacity_tokens > 0").groupBy("spec_id").agg(F.max(F.col("capacity_tokens").cast("bigint")).alias("capacity"))
    both = per.groupBy("spec_id").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).join(spec, "spec_id")
    return both.select("spec_id", "capacity", "items", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
