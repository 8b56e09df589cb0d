"""Versioned tables: immutable files, one manifest per version, deletion vectors, record deltas between versions.

Layout below ``root``::

    data/<commit>/part-*.parquet      immutable record files
    vectors/<commit>/part-*.parquet   deletion vectors: (file, position) of records that a commit removed
    manifests/<version>.json          {"version", "added", "removed", "vectors", "properties"}
    checkpoints/<version>.json        {"live", "vectors", "properties"}: the whole state, every CHECKPOINT_EVERY versions

A manifest is renamed into place without overwriting, so that of two writers of one version one fails and nothing
is half committed: files without a manifest are never read. A consumer keeps the source version that it has
processed in the ``properties`` of its own output commit, so output and progress become visible together;
after a failure at any point the next run starts from the last committed pair and neither skips nor repeats records.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweir.session import broadcast_if_small

VECTOR_SCHEMA = "file string, position bigint"
FILE, POSITION = "_lw_file", "_lw_position"
#: Versions between checkpoints, so that a state is read from one checkpoint and fewer manifests than this; keys of a
#: merge that are broadcast to the old records (checked by a count).
CHECKPOINT_EVERY, SMALL_MERGE = 10, 500_000


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class VersionedTable:
    """A table of ``schema`` below ``root``; versions count from 1."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- files and manifests

    def _files(self, folder: str, suffix: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(path) if s.getPath().getName().endswith(suffix) and s.getLen() > 0)

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return [int(f.rsplit("/", 1)[1].split(".")[0]) for f in self._files(f"{self.root}/manifests", ".json")]

    def latest(self) -> int:
        """The newest version, 0 for a table without commits."""
        return max(self.versions(), default=0)

    def _json(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int) -> dict:
        """One commit's manifest."""
        return self._json(self._manifest_path(version))

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _upto(self, version: int) -> dict:
        """Live files, vector files and merged properties at ``version``, from the last checkpoint before it on."""
        marks = [int(f.rsplit("/", 1)[1].split(".")[0]) for f in self._files(f"{self.root}/checkpoints", ".json")]
        start = max((m for m in marks if m <= version), default=0)
        state = self._json(f"{self.root}/checkpoints/{start:012d}.json") if start else {"live": [], "vectors": [], "properties": {}}
        live, vectors, properties = set(state["live"]), list(state["vectors"]), dict(state["properties"])
        for v in self.versions():
            if start < v <= version:
                m = self.manifest(v)
                live = (live - set(m["removed"])) | set(m["added"])
                vectors += m["vectors"]
                properties.update(m["properties"])
        # vectors of files that are gone delete nothing any more
        return {"live": sorted(live), "vectors": vectors if live else [], "properties": properties}

    def properties(self) -> dict:
        """Properties of all commits, later ones over earlier ones."""
        return self._upto(self.latest())["properties"]

    def state(self, version: int) -> tuple[set[str], list[str]]:
        """Live files and all vector files at ``version``."""
        at = self._upto(version)
        return set(at["live"]), at["vectors"]

    def _commit(self, version: int, added: list[str], removed: list[str], vectors: list[str], properties: dict) -> int:
        body = {"version": version, "added": added, "removed": removed, "vectors": vectors, "properties": properties}
        fc = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        temp, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp"), self._path(self._manifest_path(version))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(body), "utf-8"))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            fc.rename(temp, final, options)
        except Exception as e:
            self._fs.delete(temp, False)
            raise CommitConflict(f"version {version} exists") from e
        if version % CHECKPOINT_EVERY == 0:  # only a shortcut: readers do without one that is missing
            done = self._fs.create(self._path(f"{self.root}/checkpoints/{version:012d}.json"), True)
            done.write(bytearray(json.dumps(self._upto(version)), "utf-8"))
            done.close()
        return version

    # -- writing

    def append(self, rows: DataFrame, properties: dict | None = None) -> int:
        """Commit ``rows`` as new files; returns the version."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(folder)
        return self._commit(self.latest() + 1, self._files(folder, ".parquet"), [], [], properties or {})

    def replace_files(self, removed: list[str], rows: DataFrame, properties: dict | None = None) -> int:
        """Commit a rewrite (compaction): ``removed`` files go, ``rows`` come as new files."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(folder)
        return self._commit(self.latest() + 1, self._files(folder, ".parquet"), removed, [], properties or {})

    def merge(self, incoming: DataFrame, key: str, *, unchanged: Callable[[str, str], Column], present: Column, combine: Callable[[str, str], dict[str, Column]] | None = None, properties: dict | None = None) -> int:
        """Commit the state of ``incoming`` (one row per key) over the current version.

        ``unchanged(old, new)`` is a condition over the aliases of the present and the incoming record that keeps the
        old record; ``present`` a condition over ``incoming`` that is false for deleted keys; ``combine(old, new)`` gives the
        fields of the record to store, by default those of the incoming one. Superseded and deleted
        records go into the commit's deletion vector, new and changed ones into new files; both are written by one
        job. Keys that ``incoming`` lacks stay as they are: of the old records only the keys are looked at. Null keys are ignored.
        """
        base = self.latest()
        new = incoming.where(F.col(key).isNotNull()).withColumn("_lw_present", F.coalesce(present, F.lit(False)))
        held = self.snapshot(base, positions=True)
        if base:
            held = held.join(broadcast_if_small(new.select(key), SMALL_MERGE), key, "left_semi")
        old, new = held.alias("old"), new.alias("new")
        joined = new.join(old, F.col(f"old.{key}") == F.col(f"new.{key}"), "left")
        wanted = combine("old", "new") if combine else {}
        has_old, has_new = F.col(f"old.{FILE}").isNotNull(), F.col(f"new.{key}").isNotNull()
        alive = has_new & F.col("new._lw_present")
        keep = has_old & has_new & alive & F.coalesce(unchanged("old", "new"), F.lit(False))
        fields = [F.when(alive & ~keep, wanted[c] if c in wanted else F.col(f"new.{c}")).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        null_fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        added = F.struct(F.lit("data").alias("kind"), *fields, F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("position"))
        gone = F.struct(F.lit("vector").alias("kind"), *null_fields, F.col(f"old.{FILE}").alias("file"), F.col(f"old.{POSITION}").alias("position"))
        actions = F.filter(F.array(F.when(alive & ~keep, added), F.when(has_old & has_new & ~keep, gone)), lambda a: a.isNotNull())
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        joined.select(F.explode(actions).alias("a")).select("a.*").write.option("compression", "zstd").partitionBy("kind").parquet(folder)
        return self._commit(base + 1, self._files(f"{folder}/kind=data", ".parquet"), [], self._files(f"{folder}/kind=vector", ".parquet"), properties or {})

    def replace_where(self, gone: DataFrame, on: list[str], rows: DataFrame | None = None, properties: dict | None = None) -> int:
        """Commit the deletion of all records whose ``on`` is in ``gone``, and ``rows`` as new files, in one version."""
        base, folder, vectors, added = self.latest(), f"{self.root}/data/{uuid.uuid4().hex}", [], []
        if base:
            hit = self.snapshot(base, positions=True).join(broadcast_if_small(gone.select(*on).distinct(), SMALL_MERGE), on, "left_semi")
            hit.select(F.col(FILE).alias("file"), F.col(POSITION).alias("position")).write.option("compression", "zstd").parquet(f"{folder}-vectors")
            vectors = self._files(f"{folder}-vectors", ".parquet")
        if rows is not None:
            rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.option("compression", "zstd").parquet(folder)
            added = self._files(folder, ".parquet")
        return self._commit(base + 1, added, [], vectors, properties or {})

    # -- reading

    def _read(self, files: list[str], schema: T.StructType | str, positions: bool = False) -> DataFrame:
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({FILE: F.lit(None).cast("string"), POSITION: F.lit(None).cast("bigint")}) if positions else empty
        df = self.spark.read.schema(schema).parquet(*files)
        # names of data files carry the id of their write job, so the name alone tells the file
        return df.select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(POSITION)) if positions else df

    def _without(self, rows: DataFrame, vectors: list[str]) -> DataFrame:
        if not vectors:
            return rows
        gone = self._read(vectors, VECTOR_SCHEMA)
        return rows.join(gone, (rows[FILE] == gone["file"]) & (rows[POSITION] == gone["position"]), "left_anti")

    def snapshot(self, version: int | None = None, positions: bool = False) -> DataFrame:
        """All records of a version."""
        live, vectors = self.state(self.latest() if version is None else version)
        rows = self._without(self._read(sorted(live), self.schema, positions=bool(vectors) or positions), vectors)
        return rows if positions else rows.select(*self.schema.names)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Record deltas from version ``since`` to ``until``, from manifests alone: columns of the table and ``change``.

        ``added`` are the records of files that became live, less their deleted positions; ``removed`` those of files
        that ceased to be live, and the positions that vectors deleted meanwhile. Files live in both versions are
        read only where a new vector names them, so that the cost follows the change and not the table.
        """
        until = self.latest() if until is None else until
        live_a, vectors_a = self.state(since)
        live_b, vectors_b = self.state(until)
        fresh = [v for v in vectors_b if v not in set(vectors_a)]
        added = self._without(self._read(sorted(live_b - live_a), self.schema, positions=True), vectors_b)
        out = [added.select(*self.schema.names, F.lit("added").alias("change"))]
        if live_a - live_b:
            lost = self._without(self._read(sorted(live_a - live_b), self.schema, positions=True), vectors_a)
            out.append(lost.select(*self.schema.names, F.lit("removed").alias("change")))
        if fresh:
            gone = self._read(fresh, VECTOR_SCHEMA)
            kept = self._read(sorted(live_a & live_b), self.schema, positions=True)
            hit = kept.join(gone, (kept[FILE] == gone["file"]) & (kept[POSITION] == gone["position"]), "left_semi")
            out.append(hit.select(*self.schema.names, F.lit("removed").alias("change")))
        result = out[0]
        for df in out[1:]:
            result = result.unionByName(df)
        return result


def process_changes(source: VersionedTable, output: VersionedTable, step: Callable[[DataFrame], DataFrame], name: str = "source") -> int | None:
    """Run ``step`` over the records that changed since the last successful run; returns the output's version.

    The processed source version is read from, and saved in, the output's commits. Nothing is committed, and None
    returned, where the source has no new version. If ``step`` or the write fails, the output stays as it was.
    """
    done = int(output.properties().get(f"processed.{name}", 0))
    until = source.latest()
    if until <= done:
        return None
    return output.append(step(source.changes(done, until)), {f"processed.{name}": until})
