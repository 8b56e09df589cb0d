"""Mixing sources to target weights (problem 9), by Pfair scheduling.

Every source is a stream of blocks. Block j of a source with weight w has release floor(j / w) and deadline
ceil((j + 1) / w), closed expressions of the row itself; the frame of a block is that of the middle between them. Frames have
FRAME slots, whatever the size of the mix, and are scheduled apart from each other, earliest deadline first among the
released blocks: blocks never grow, and no schedule of the whole mix is held anywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweir.session import materialize

#: Tokens of a block; slots of a frame.
BLOCK_TOKENS, FRAME = 512, 1024
#: Sources of a mix; more would need a distributed plan.
MAX_SOURCES = 10_000
_BUCKET_ROWS = 20_000


def budgets(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: int | None) -> dict[str, int]:
    """Tokens that each source contributes to a mix of ``total`` tokens.

    By default the total is the largest at which every source that has texts reaches its target within its repeats.
    Beyond it, no source gives more than max_repeats times its tokens, and what the small ones cannot give is shared
    out among the others by their targets while these can give it.
    """
    most = {s: sizes.get(s, 0) * r for s, _, r in targets}
    if total is None:
        weight = sum(t for s, t, _ in targets if most[s] > 0)
        total = min((int(most[s] * weight / t) for s, t, _ in targets if most[s] > 0), default=0)
    given: dict[str, int] = {}
    free = {s: t for s, t, _ in targets if t > 0 and most[s] > 0}
    while free:
        left, weight = total - sum(given.values()), sum(free.values())
        short = [s for s, t in free.items() if left * t / weight >= most[s]]
        if not short:
            return given | {s: max(1, round(left * t / weight)) for s, t in free.items()}
        for s in short:
            given[s] = most[s]
            del free[s]
    return given


def blocks_before(budget: int, total: int, block: int, frame: int, slots: int) -> int:
    """Blocks of a source whose frame comes before ``frame``: those with (j + 1/2) / w < frame * slots."""
    return min(-(-budget // block), max(0, -(-(2 * budget * frame * slots - total) // (2 * total))))


def frame_schedule(budget: dict[str, int], block: int, frame: int, slots: int = FRAME) -> list[tuple[str, int, int]]:
    """(source, block number, slot) of one frame, earliest deadline first among the released blocks, in exact integers."""
    total = sum(budget.values())
    begin, end = ({s: blocks_before(b, total, block, f, slots) for s, b in budget.items()} for f in (frame, frame + 1))
    slot, t, out = sum(begin.values()), frame * slots, []
    waiting = [(begin[s] * total // budget[s], s, begin[s]) for s in sorted(budget) if end[s] > begin[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    while waiting or ready:
        if not ready and waiting[0][0] > t:
            t = waiting[0][0]
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // budget[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        slot, t = slot + 1, t + 1
        if j + 1 < end[s]:
            heapq.heappush(waiting, ((j + 1) * total // budget[s], s, j + 1))
    return out


def pfair_schedule(budget: dict[str, int], block: int, slots: int = FRAME) -> list[tuple[str, int, int]]:
    """The schedules of all frames, one behind the other."""
    out: list[tuple[str, int, int]] = []
    todo, frame = sum(-(-b // block) for b in budget.values()), 0
    while len(out) < todo:
        out += frame_schedule(budget, block, frame, slots)
        frame += 1
    return out


def largest_lag(schedule: list[tuple[str, int, int]], budget: dict[str, int]) -> dict[str, float]:
    """Per source, the greatest deviation, in blocks, of its blocks so far from its weight times the slots so far."""
    total, lag = sum(budget.values()), dict.fromkeys(budget, 0.0)
    for s, j, slot in schedule:
        due = slot * budget[s] / total  # just before and just after the slot the deviation is extreme
        lag[s] = max(lag[s], abs(j - due), abs(j + 1 - due - budget[s] / total))
    return lag


def _positions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with ``before``: tokens of the earlier documents of their source, in hash order; two-level prefix sums."""
    docs = sizes.where("tokens > 0 and source is not null").join(targets, "source", "left_semi").withColumn("_h", F.xxhash64("doc_id"))
    rows = max(1, docs.count())
    bits = max(1, (rows // _BUCKET_ROWS).bit_length())
    docs = docs.withColumn("_b", F.expr(f"shiftright(_h, {64 - bits})"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("source", "_b").agg(F.sum("tokens").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return docs.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(F.broadcast(sums) if bits < 8 else sums, ["source", "_b"]).select("doc_id", "source", "tokens", (F.col("_base") + F.col("_in")).alias("before"))


def _targets(mix_targets: DataFrame) -> DataFrame:
    """(source, t, r): share and repeats of each source to be mixed, each once."""
    return mix_targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r"))


def all_tokens(sizes: DataFrame, mix_targets: DataFrame) -> int:
    """Tokens of all texts of the sources to be mixed, each text once: the size of a mix that passes over no source."""
    known = sizes.where("tokens > 0").join(F.broadcast(_targets(mix_targets).select("source")), "source", "left_semi")
    return int(known.agg(F.sum("tokens")).first()[0] or 0)


def _plan(sizes: DataFrame, mix_targets: DataFrame, total: int | None) -> tuple[DataFrame, list, dict[str, int], dict[str, int]]:
    per = _targets(mix_targets)
    rows = per.orderBy("source").head(MAX_SOURCES + 1)
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = [(r["source"], float(r["t"]), int(r["r"])) for r in rows]
    known = sizes.where("tokens > 0").join(F.broadcast(per.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n"))
    have = {r["source"]: int(r["n"]) for r in known.collect()}  # one row per mixed source
    return per, targets, have, budgets(targets, have, total)


def _frame(total: int, slots: int) -> Column:
    """Frame of block _j of a source with ``budget``, as a closed expression; the last part of a budget may be a short block."""
    return F.expr(f"(cast(_j as decimal(38,0)) * 2 + 1) * cast({total} as decimal(38,0)) div (cast(budget as decimal(38,0)) * {2 * slots})").cast("bigint")


def _slots(budget: dict[str, int], block: int, slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, plan = None, {}
        for pdf in batches:
            out = []
            for f, s, j in zip(pdf["frame"], pdf["source"], pdf["_j"], strict=True):
                if f != now:  # rows are sorted by frame
                    now, plan = f, {(x, k): slot for x, k, slot in frame_schedule(budget, block, int(f), slots)}
                out.append(plan[s, j])
            yield pdf.assign(slot=pd.Series(out, index=pdf.index, dtype="int64"))[["frame", "slot", "place", "source", "doc_id", "copy", "tokens"]]

    return run


def _mix(sizes: DataFrame, per: DataFrame, have: dict[str, int], budget: dict[str, int], block: int, slots: int) -> DataFrame:
    """The mix with the frame of each row."""
    spark, total = sizes.sparkSession, sum(budget.values())
    plan = spark.createDataFrame([(s, b, have[s]) for s, b in budget.items()], "source string, budget bigint, supply bigint")
    docs = _positions(sizes, F.broadcast(per.select("source"))).join(F.broadcast(plan), "source")
    uses = docs.where("before + tokens div 2 < budget").withColumn("copy", F.explode(F.expr("sequence(0, cast((budget - before - tokens div 2 - 1) div supply as int))")))
    placed = uses.withColumn("place", F.col("copy") * F.col("supply") + F.col("before")).withColumn("_j", F.expr(f"(place + tokens div 2) div {block}"))
    placed = placed.withColumn("frame", _frame(total, slots)).select("frame", "place", "source", "doc_id", (F.col("copy") + 1).cast("int").alias("copy"), "tokens", "_j")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = placed.repartition(parts, "frame").sortWithinPartitions("frame")
    return rows.mapInPandas(_slots(budget, block, slots), "frame bigint, slot bigint, place bigint, source string, doc_id bigint, copy int, tokens bigint")


def mix_sources(sizes: DataFrame, mix_targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, slots: int = FRAME) -> DataFrame:
    """(slot, place, source, doc_id, copy, tokens): the mix, ordered by (slot, place).

    Each source is a stream of its documents in hash order, repeated up to max_repeats times and cut at the document
    whose middle passes its budget (see budgets); no document is cut. The documents whose middle lies in tokens [jB, (j + 1)B) of the stream are its block j. Blocks
    are interleaved by Pfair scheduling in frames of ``slots`` slots: in a mix of one frame each source is at every slot
    less than one block from its weight; frames begin within half a block of the weights, and share_report measures what
    the placed tokens keep (a document longer than a block stays whole in the block of its middle).
    ``place`` is the document's offset in the stream, ``copy`` counts its uses from 1. Documents without tokens, with
    a null source or of a source without a target are no part of the mix; repeated targets count once. Positions
    are two-level prefix sums over hash buckets, so that a source with a third of all rows is no single task; frames
    are even whatever source dominates.
    """
    per, _, have, budget = _plan(sizes, mix_targets, total)
    return _mix(sizes, per, have, budget, block, slots).drop("frame")


def placed_lag(mixed: DataFrame, budget: dict[str, int], block: int) -> DataFrame:
    """(source, largest_lag): the greatest deviation, in blocks, of a source's tokens so far from its weight times all tokens so far.

    Prefix sums in two levels, over frames and inside each; the extremes lie just before and just after a source's own blocks.
    """
    total = max(1, sum(budget.values()))
    weights = F.broadcast(mixed.sparkSession.createDataFrame([(s, b / total) for s, b in budget.items()], "source string, weight double"))  # a row per source
    cells = mixed.groupBy("frame", "slot", "source").agg(F.sum("tokens").alias("n"))
    per = cells.groupBy("frame", "source").agg(F.sum("n").alias("n"))
    grid = per.select("frame").distinct().join(weights.select("source"), how="cross")  # frames by a bounded number of sources
    earlier = Window.partitionBy("source").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    base = grid.join(per, ["frame", "source"], "left").withColumn("own", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    base = base.withColumn("all", F.sum("own").over(Window.partitionBy("frame")))
    so_far = Window.partitionBy("frame").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("frame", "source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    d = cells.withColumns({"_t": F.coalesce(F.sum("n").over(so_far), F.lit(0)), "_o": F.coalesce(F.sum("n").over(own), F.lit(0))}).join(base, ["frame", "source"]).join(weights, "source")
    before = F.col("own") + F.col("_o") - F.col("weight") * (F.col("all") + F.col("_t"))
    return d.groupBy("source").agg(F.max(F.greatest(F.abs(before), F.abs(before + F.col("n") * (1 - F.col("weight"))))).alias("lag")).select("source", (F.col("lag") / block).alias("largest_lag"))


def share_report(sizes: DataFrame, mix_targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, slots: int = FRAME) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies, max_repeats, exhausted, largest_lag).

    One row per target; ``exhausted`` marks sources that give all that their repeats allow, ``largest_lag`` is the
    greatest deviation of the placed tokens from the weight at any slot, in blocks.
    """
    spark = sizes.sparkSession
    sizes = materialize(sizes, "sizes")
    per, targets, have, budget = _plan(sizes, mix_targets, total)
    mix = materialize(_mix(sizes, per, have, budget, block, slots), "mix")
    mixed = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.max("copy").alias("most_copies"))
    plan = spark.createDataFrame([(s, t, r, budget.get(s, 0) >= have.get(s, 0) * r) for s, t, r in targets], "source string, target_share double, max_repeats int, exhausted boolean")
    whole = Window.partitionBy(F.lit(0))  # a row per source
    both = F.broadcast(plan).join(mixed, "source", "left").join(placed_lag(mix, budget, block), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.select(
        "source", "target_share", F.round(F.col("tokens") / F.sum("tokens").over(whole), 6).alias("reached_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "exhausted", F.round("largest_lag", 6).alias("largest_lag")
    )
