"""References to records that do not exist (problem 3).

Sorted integer parent keys are compressed into contiguous runs; a reference is as-of matched to the preceding run
start and is an orphan beyond the run's end. The same match serves keys (ids), lifetimes (microseconds from created
to removed) and versions of a record (a run from each version on, empty for inactive ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per bucket of a run table of ids; microseconds per bucket of a run table of times (a day).
ID_WIDTH, TIME_WIDTH = 1 << 16, 86_400_000_000
#: Run tables of at most this many rows (checked by a count) are broadcast.
SMALL_RUNS = 10_000
FOREVER = (1 << 63) - 1


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _bucket(key: str, width: int) -> Column:
    return F.floor(F.col(key) / F.lit(width)).cast("bigint") if width < 2 else F.expr(f"{key} div {width} - if(pmod({key}, {width}) <> 0 and {key} < 0, 1, 0)")


def contiguous_runs(parents: DataFrame, key: str, group: list[str] | None = None, width: int = ID_WIDTH) -> DataFrame:
    """(group..., run_start, run_end): the distinct keys of ``parents`` as maximal runs of consecutive integers.

    Islands are found inside buckets of ``width`` keys, so that no task holds an unbounded group; only runs that
    touch a bucket's edge are stitched across buckets. Null keys are left out; repeats count once.
    """
    group = group or []
    keys = parents.where(F.col(key).isNotNull()).select(*group, F.col(key).cast("bigint").alias("_k")).distinct().withColumn("_b", _bucket("_k", width))
    inside = Window.partitionBy(*group, "_b").orderBy("_k")
    local = keys.withColumn("_island", F.col("_k") - F.row_number().over(inside)).groupBy(*group, "_b", "_island").agg(F.min("_k").alias("s"), F.max("_k").alias("e"))
    at_edge = (F.pmod("s", F.lit(width)) == 0) | (F.pmod("e", F.lit(width)) == width - 1)
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("s")
    edge = local.where(at_edge).withColumn("_new", F.when(F.col("s") == F.lag("e").over(across) + 1, 0).otherwise(1))
    edge = edge.withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edge.groupBy(*group, "_run").agg(F.min("s").alias("run_start"), F.max("e").alias("run_end")).drop("_run")
    return local.where(~at_edge).select(*group, F.col("s").alias("run_start"), F.col("e").alias("run_end")).unionByName(stitched)


def match_runs(refs: DataFrame, runs: DataFrame, key: str, group: list[str], width: int) -> DataFrame:
    """Distinct (group..., key) of ``refs`` with ``run``: the columns of the run whose start precedes the key, or null.

    Distributed as-of match: both sides meet in (group, bucket) partitions; the last run of each bucket is carried
    into the later ones over a table that has one row per group and bucket. A hot group is thereby split by bucket,
    and repeated references are reduced to distinct keys before anything is sorted.
    """
    payload = [c for c in runs.columns if c not in group]
    point = refs.where(F.col(key).isNotNull()).select(*group, F.col(key).alias("_k")).distinct().withColumn("_b", _bucket("_k", width))
    run = F.struct("run_start", *[c for c in payload if c != "run_start"])
    parent = runs.select(*group, run.alias("_run"), F.col("run_start").alias("_k")).withColumn("_b", _bucket("_k", width))
    last = parent.groupBy(*group, "_b").agg(F.max("_run").alias("_run"))
    none = F.lit(None).cast(last.schema["_run"].dataType)
    seen = last.unionByName(point.select(*group, "_b").distinct().withColumn("_run", none)).groupBy(*group, "_b").agg(F.max("_run").alias("_run"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.withColumn("_run", F.last("_run", ignorenulls=True).over(before)).where("_run is not null").withColumn("_k", F.col("_run.run_start"))
    events = (
        parent.select(*group, "_b", "_k", "_run", F.lit(0).alias("_kind"))
        .unionByName(carried.select(*group, "_b", "_k", "_run", F.lit(0).alias("_kind")))
        .unionByName(point.select(*group, "_b", "_k", none.alias("_run"), F.lit(1).alias("_kind")))
    )
    upto = Window.partitionBy(*group, "_b").orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = events.withColumn("run", F.last("_run", ignorenulls=True).over(upto)).where("_kind = 1")
    return matched.select(*group, F.col("_k").alias(key), "run")


def missing_keys(refs: DataFrame, runs: DataFrame, key: str, group: list[str], width: int) -> DataFrame:
    """The distinct (group..., key) of ``refs`` beyond the end of the run that precedes them, or before any run."""
    matched = match_runs(refs, runs, key, group, width)
    return matched.where(F.col("run").isNull() | (F.col(key) > F.col("run.run_end"))).drop("run")


def lifetimes(collections: DataFrame) -> DataFrame:
    """Collections with ``run_start`` and ``run_end``: from created to just before removed_at, in microseconds."""
    return (
        collections.where("collection_id is not null and created is not null")
        .select("collection_id", "space_name", "collection_name", micros("created").alias("run_start"), F.coalesce(micros("removed_at") - 1, F.lit(FOREVER)).alias("run_end"))
        .distinct()
    )


def maximal_lifetimes(collections: DataFrame) -> DataFrame:
    """(collection_id, run_start, run_end): the times at which an id exists as maximal runs; its lifetimes that overlap
    or touch are merged, since an as-of match sees one run only."""
    each = lifetimes(collections).where("run_end >= run_start").select("collection_id", "run_start", "run_end")
    order = Window.partitionBy("collection_id").orderBy("run_start", "run_end")
    until = F.max("run_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_new", F.when(F.col("run_start") - 1 <= until, 0).otherwise(1))
    each = each.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("collection_id", "_run").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")).drop("_run")


def orphan_document_rows(document_rows: DataFrame, collections: DataFrame) -> DataFrame:
    """(ref_id, at) of the rows whose collection_id names no collection that exists at recorded_at, each row_id once.

    Ids that never existed lie beyond the runs of consecutive collection ids; the others are matched to the
    maximal lifetimes of their collection. Null references and rows without recorded_at are no orphans; with no
    collections at all every reference is one.
    """
    refs = document_rows.where("collection_id is not null and recorded_at is not null").select("row_id", "collection_id", "recorded_at", micros("recorded_at").alias("t"))
    unknown = missing_keys(refs, contiguous_runs(collections, "collection_id"), "collection_id", [], ID_WIDTH)
    gone = missing_keys(refs.join(broadcast_known(unknown), "collection_id", "left_anti"), maximal_lifetimes(collections), "t", ["collection_id"], TIME_WIDTH)
    bad = refs.join(gone, ["collection_id", "t"], "left_semi").select("row_id", "recorded_at", F.lit("not there at the time").alias("reason"))
    bad = bad.unionByName(refs.join(broadcast_known(unknown), "collection_id", "left_semi").select("row_id", "recorded_at", F.lit("never existed").alias("reason")))
    return bad.groupBy(F.col("row_id").alias("ref_id")).agg(F.min("recorded_at").alias("at"), F.max("reason").alias("reason"))


def broadcast_known(df: DataFrame) -> DataFrame:
    """Broadcast hint where a count proves the frame small."""
    return F.broadcast(df) if len(df.head(SMALL_RUNS + 1)) <= SMALL_RUNS else df


def tidy_segments(path: Column) -> Column:
    """Segments of a judged path: surrounding white space trimmed, backslashes as slashes, empty and '.' ones dropped."""
    trimmed = F.regexp_replace(path, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return F.filter(F.split(F.regexp_replace(trimmed, r"\\", "/"), "/", -1), lambda s: (s != "") & (s != "."))


def orphan_judgments(eval_judgments: DataFrame, eval_cases: DataFrame, collections: DataFrame, document_rows: DataFrame) -> DataFrame:
    """(ref_id, at) of the judgments whose path leads to no active document at judged_at, each judgment_id once.

    The path names a collection, found among the lifetimes of its (space, name), and a document, found among the
    versions of (collection, path): each version is a run from its recorded_at on, and an empty one where it is
    inactive. Null paths and judgments without a time are no orphans; a path without enough segments is one; a
    judgment of an unknown case is read like one of a case without a space.
    """
    spaces = eval_cases.where("case_id is not null").groupBy("case_id").agg(F.max("space_name").alias("case_space"))
    refs = (
        eval_judgments.where("path is not null and judged_at is not null")
        .select("judgment_id", "case_id", "judged_at", micros("judged_at").alias("t"), tidy_segments(F.col("path")).alias("seg"))
        .join(broadcast_known(spaces), "case_id", "left")
        .withColumn("space_name", F.coalesce("case_space", F.try_element_at("seg", F.lit(1))))
        .withColumn("skip", F.when(F.col("case_space").isNull(), 1).otherwise(0))
        .withColumn("collection_name", F.try_element_at("seg", F.col("skip") + 1))
        .withColumn("doc_path", F.array_join(F.slice("seg", F.col("skip") + 2, F.greatest(F.size("seg") - F.col("skip") - 1, F.lit(0))), "/"))
        .select("judgment_id", "judged_at", "t", "space_name", "collection_name", "doc_path")
    )
    life = lifetimes(collections).where("space_name is not null and collection_name is not null")
    found = refs.join(broadcast_known(life), ["space_name", "collection_name"], "left").withColumn("exists", F.coalesce(F.col("t").between(F.col("run_start"), F.col("run_end")), F.lit(False)))
    placed = found.where("exists").select("judgment_id", "judged_at", "t", "collection_id", "doc_path")
    keyed = document_rows.where("collection_id is not null and path is not null and recorded_at is not null").select("collection_id", F.col("path").alias("doc_path"), micros("recorded_at").alias("run_start"), "row_id", "active")
    versions = keyed.groupBy("collection_id", "doc_path", "run_start").agg(F.max_by(F.coalesce("active", F.lit(False)), "row_id").alias("on"))
    within = Window.partitionBy("collection_id", "doc_path", _bucket("run_start", TIME_WIDTH)).orderBy("run_start")
    turns = versions.withColumn("_same", F.lag("on").over(within) == F.col("on")).where("_same is null or not _same")
    runs = turns.select("collection_id", "doc_path", "run_start", F.when(F.col("on"), F.lit(FOREVER)).otherwise(F.col("run_start") - 1).alias("run_end"))
    gone = missing_keys(placed, runs, "t", ["collection_id", "doc_path"], TIME_WIDTH)
    doc_gone = placed.join(gone, ["collection_id", "doc_path", "t"], "left_semi").select("judgment_id", "judged_at", F.lit("no document").alias("reason"))
    nowhere = found.groupBy("judgment_id").agg(F.bool_or("exists").alias("any"), F.min("judged_at").alias("judged_at")).where("not any").select("judgment_id", "judged_at", F.lit("no collection").alias("reason"))
    return doc_gone.unionByName(nowhere).groupBy(F.col("judgment_id").alias("ref_id")).agg(F.min("judged_at").alias("at"), F.max("reason").alias("reason"))


def orphan_references(document_rows: DataFrame, collections: DataFrame, eval_judgments: DataFrame, eval_cases: DataFrame) -> DataFrame:
    """(ref_table, ref_id, at, reason) of the orphans of both referring tables."""
    rows = orphan_document_rows(document_rows, collections).withColumn("ref_table", F.lit("document_rows"))
    judged = orphan_judgments(eval_judgments, eval_cases, collections, document_rows).withColumn("ref_table", F.lit("eval_judgments"))
    return rows.unionByName(judged).select("ref_table", "ref_id", "at", "reason")


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """(ref_table, month, orphans): counts per referring table and month of the reference."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))
