"""Documents that the next update still has to process (problem 1).

The state of every document, its newest row and its latest durable item, is a versioned table that stays between runs.
A run compares the files of the source tables with those that the state's last commit names, reads the added ones alone,
and merges their records over the state; the files it has read are saved in that same commit. So a run that fails
leaves state and progress as they were, and the next one neither skips nor repeats a record.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweir.session import fresh_path, materialize, shared_root
from lodeweir.sources.versioned import VersionedTable

_ROW = "struct<recorded_at:timestamp,row_id:bigint,hash:string,fts_dirty:boolean,active:boolean>"
_ITEM = "struct<processed_at:timestamp,run_id:bigint,item_seq:bigint,hash:string>"
STATE = f"doc_id bigint, row {_ROW}, item {_ITEM}, pending boolean"
WAITING = "run_id bigint, item_seq bigint, doc_id bigint, hash string, processed_at timestamp"
SOURCES = ("document_rows", "update_runs", "update_items")


def newest_rows(document_rows: DataFrame) -> DataFrame:
    """The newest row of each document by recorded_at (ties: the higher row_id); rows without doc_id are ignored."""
    row = F.struct("recorded_at", "row_id", "hash", "fts_dirty", "active")
    return document_rows.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(row, F.struct("recorded_at", "row_id")).cast(_ROW).alias("row"))


def known_runs(update_runs: DataFrame) -> DataFrame:
    """(run_id, ok, upto): whether a run succeeded, and its checkpoint; repeated runs count once."""
    return update_runs.groupBy("run_id").agg(F.bool_or(F.coalesce(F.col("status") == "succeeded", F.lit(False))).alias("ok"), F.max("checkpoint_seq").alias("upto"))


def usable_items(update_items: DataFrame) -> DataFrame:
    """Items that count once their run makes them durable."""
    kept = update_items.where("coalesce(outcome, '') <> 'extract_failed' and doc_id is not null")
    return kept.select("run_id", "item_seq", "doc_id", "hash", F.col("processed_at").cast("timestamp").alias("processed_at"))


def latest_items(durable: DataFrame) -> DataFrame:
    """The latest durable item of each document."""
    item = F.struct("processed_at", "run_id", "item_seq", "hash")
    return durable.groupBy("doc_id").agg(F.max_by(item, F.struct("processed_at", "run_id", "item_seq")).cast(_ITEM).alias("item"))


def is_pending(row: Column, item: Column) -> Column:
    """Active, and not processed durably, or with another hash, or with a full-text flag set since. A null hash differs from
    any other value, a null flag is false, a null active means inactive."""
    dirty = F.coalesce(row["fts_dirty"], F.lit(False)) & F.coalesce(item["processed_at"] < row["recorded_at"], F.lit(False))
    return F.coalesce(row["active"], F.lit(False)) & (item.isNull() | ~item["hash"].eqNullSafe(row["hash"]) | dirty)


class PendingState:
    """The state below ``root``, with the items whose run has not made them durable yet in a table of their own.

    That table is committed first and the state names its version, so a failure between the two commits changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        schema = lambda s: spark.createDataFrame([], s).schema
        self.spark = spark
        self.state = VersionedTable(spark, f"{root}/state", schema(STATE))
        self.waiting = VersionedTable(spark, f"{root}/waiting", schema(WAITING))

    def update(self, rows: DataFrame, runs: DataFrame, items: DataFrame, sources: dict | None = None) -> int:
        """Merge added rows and items over the state, and the waiting items that the runs have made durable since.

        ``runs`` are all runs: one row each after aggregation. Only documents that the added records name are written.
        """
        held = self.waiting.snapshot(int(self.state.properties().get("waiting", 0)))
        usable = materialize(usable_items(items).unionByName(held).join(known_runs(runs), "run_id", "left").withColumn("durable", F.coalesce(F.col("ok") | (F.col("item_seq") <= F.col("upto")), F.lit(False))), "items", partition_by=["durable"])
        live, _ = self.waiting.state(self.waiting.latest())
        version = self.waiting.replace_files(sorted(live), usable.where("not durable").select("run_id", "item_seq", "doc_id", "hash", "processed_at").distinct())
        touched = materialize(newest_rows(rows).join(latest_items(usable.where("durable")), "doc_id", "full_outer"), "touched")

        def both(old: str, new: str) -> dict[str, Column]:
            row, item = F.greatest(f"{old}.row", f"{new}.row"), F.greatest(f"{old}.item", f"{new}.item")
            return {"row": row, "item": item, "pending": F.coalesce(is_pending(row, item), F.lit(False))}

        def same(old: str, new: str) -> Column:
            found = both(old, new)
            return found["row"].eqNullSafe(F.col(f"{old}.row")) & found["item"].eqNullSafe(F.col(f"{old}.item"))

        return self.state.merge(touched, "doc_id", unchanged=same, present=F.lit(True), combine=both, properties={"waiting": version, "touched": touched.count(), **({"sources": json.dumps(sources)} if sources is not None else {})})

    def pending(self) -> DataFrame:
        """(doc_id, hash, stamp) of the documents to process."""
        return self.state.snapshot().where("pending").select("doc_id", F.col("row.hash").alias("hash"), F.col("row.recorded_at").alias("stamp"))


def pending_documents(document_rows: DataFrame, update_runs: DataFrame, update_items: DataFrame) -> DataFrame:
    """(doc_id, hash, stamp) of the documents that the next update has to process, each once, by one run over a new state.

    A run with most of the items is split by adaptive skew handling. Runs that are not known have no durable items.
    Nulls: see is_pending. Empty tables give an empty result; further columns are ignored.
    """
    state = PendingState(document_rows.sparkSession, fresh_path(document_rows.sparkSession, "pending"))
    state.update(document_rows, update_runs, update_items)
    return state.pending()


def source_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Files of a parquet table: path -> size and modification time, which stand for its version."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    found, it = {}, fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found[f.getPath().toString()] = f"{f.getLen()}:{f.getModificationTime()}"
    return found


def incremental_pending(spark: SparkSession, tables: str, root: str | None = None) -> PendingState:
    """Bring the state of the tables in a folder up to date from the files added since its last commit.

    The state lies in the shared folder under a name made from ``tables``, or below ``root``. Where nothing was added nothing is
    read but manifests; where a file was removed or rewritten a new state is begun, since what it held cannot be taken back.
    """
    root = root or f"{shared_root(spark)}/lodeweir/state/pending-{hashlib.sha256(tables.encode()).hexdigest()[:16]}"
    now = {name: source_files(spark, f"{tables}/{name}.parquet") for name in SOURCES}
    epoch = 0
    while True:
        state = PendingState(spark, f"{root}/{epoch}")
        if not state.state.latest():
            done = {name: {} for name in SOURCES}
            break
        done = json.loads(state.state.properties()["sources"])
        if all(now[name].get(f) == v for name in SOURCES for f, v in done[name].items()):
            break
        epoch += 1
    added = {name: sorted(set(now[name]) - set(done[name])) for name in SOURCES}
    if any(added.values()) or not state.state.latest():
        whole = {name: spark.read.parquet(f"{tables}/{name}.parquet") for name in SOURCES}
        fresh = {name: spark.read.schema(whole[name].schema).parquet(*added[name]) if added[name] else whole[name].where(F.lit(False)) for name in SOURCES}
        state.update(fresh["document_rows"], whole["update_runs"], fresh["update_items"], now)
    return state
