"""Session helpers: tables, the shared folder, materialised cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_FRESH: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of one data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master
    local. Elsewhere it must be set, since executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="lodeweir-")
    return _OWN_DIRS[app]


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_root(spark)}/lodeweir/{purpose}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        # results are read lazily, so folders are tidied when the driver ends, or by tidy() where results are written
        atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    _FRESH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def tidy(spark: SparkSession) -> int:
    """Delete this application's intermediate tables wherever they lie, once results are written; returns how many."""
    paths = _FRESH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def materialize(df: DataFrame, purpose: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, lost executors cost nothing.

    A written table is computed once; ``checkpoint()`` would compute its input twice.
    """
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame, rows_hint_cols: list[str] | None = None) -> DataFrame:
    """Redistribute rows evenly before heavy per-row work (small files would give a single task)."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(c) for c in rows_hint_cols or []])


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only where a count proves that ``df`` has at most ``max_rows`` rows; else the plain frame."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(max_rows + 1)) <= max_rows else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lodeweir-')}/{here.name}", "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(archive)
