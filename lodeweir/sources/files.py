"""Files of a collection: walk, ignore rules, extension filters, hashes."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and files that are never indexed.
IGNORED_DIRS = (".git", "node_modules", "target", "dist", "build", ".next", ".turbo", ".venv", "venv", "__pycache__", ".pytest_cache", ".cache", "coverage")
IGNORED_FILES = (r"\.DS_Store", r"[^/]+\.(?i:lock)")


def not_hard_ignored(path: str | Column = "rel_path") -> Column:
    """Whether no folder of a relative path (letter case apart), and not the file itself, is ignored always."""
    dirs = "|".join(re.escape(d) for d in IGNORED_DIRS)
    files = "|".join(IGNORED_FILES)
    p = F.col(path) if isinstance(path, str) else path
    return ~(p.rlike(f"(?i)(^|/)({dirs})/") | p.rlike(f"(^|/)({files})$"))


def normalize_extensions(extensions: list[str] | None) -> list[str]:
    """Extensions trimmed, without dots and in lower case; an empty list filters nothing."""
    return sorted({e.strip().lstrip(".").lower() for e in extensions or [] if e.strip().lstrip(".")})


def extension_allowed(extensions: list[str] | None, path: str = "rel_path") -> Column:
    """Whether a path has one of the extensions."""
    wanted = normalize_extensions(extensions)
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(wanted) if wanted else F.lit(True)


def ignore_rules(patterns: str) -> list[tuple[str, bool]]:
    """(Java regex over relative paths, whether it excludes) per ignore line, in order; the last match decides."""
    rules = []
    for line in patterns.splitlines():
        p = line.rstrip()
        if not p.strip() or p.startswith("#"):
            continue
        excludes = not p.startswith("!")
        p = p.lstrip("!").removeprefix("\\")
        only_dir = p.endswith("/")
        anchored = "/" in p.rstrip("/")
        p = p.strip("/")
        parts = re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]+\])", p)
        special = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(special.get(x) or (x.replace("[!", "[^") if x.startswith("[") else re.escape(x)) for x in parts)
        rules.append((("^" if anchored else "(?:^|/)") + body + ("/" if only_dir else "(?:/|$)"), excludes))
    return rules


def not_ignored(rules: list[tuple[str, bool]], path: str = "rel_path") -> Column:
    """Whether the last rule that matches a path, if any, does not exclude it."""
    verdict = F.lit(True)
    for regex, excludes in rules:
        verdict = F.when(F.col(path).rlike(regex), F.lit(not excludes)).otherwise(verdict)
    return verdict


def count_ignore_patterns(text: str) -> int:
    """Ignore lines that are neither empty nor comments."""
    return sum(1 for line in text.splitlines() if line.strip() and not line.strip().startswith("#"))


def add_ignore_pattern(text: str, pattern: str) -> str:
    """Ignore text with a pattern, once."""
    lines = text.splitlines()
    return "\n".join(lines if pattern in lines else [*lines, pattern]) + "\n"


def remove_ignore_pattern(text: str, pattern: str) -> str:
    """Ignore text without the lines that are the pattern."""
    left = [line for line in text.splitlines() if line != pattern]
    return "\n".join(left) + ("\n" if left else "")


def _walk(spark: SparkSession, root: str) -> tuple[list[tuple[str, str, int, int]], list[str]]:
    """((full path, relative path, modified (ns), size) of all files below a root, folders that could not be read).

    Metadata alone, on the driver: hard-ignored folders are not entered, links not followed, hidden files count.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(root if ":" in root else "file://" + os.path.abspath(root))
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out, failed, todo = [], [], [(top, "")]
    ignored = {d.lower() for d in IGNORED_DIRS}
    while todo:
        folder, rel = todo.pop()
        try:
            entries = list(fs.listStatus(folder))
        except Exception:  # noqa: BLE001
            failed.append(rel)
            continue
        for e in entries:
            name = e.getPath().getName()
            below = f"{rel}/{name}" if rel else name
            if e.isDirectory():
                if name.lower() not in ignored:
                    todo.append((e.getPath(), below))
            elif not name.endswith(".crc"):
                out.append((e.getPath().toString(), below, e.getModificationTime() * 1_000_000, e.getLen()))
    return out, failed


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None, patterns: str = "", failed: list[str] | None = None) -> DataFrame:
    """(full_path, rel_path, modified (ns), size) of the files to index; contents are not read. ``failed`` gets the folders
    that could not be read."""
    found, lost = _walk(spark, root)
    if failed is not None:
        failed += lost
    df = spark.createDataFrame(found, "full_path string, rel_path string, modified bigint, size bigint")
    return df.where(not_hard_ignored() & extension_allowed(extensions) & not_ignored(ignore_rules(patterns)))


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        found = []
        for p in pdf["full_path"]:
            system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p).replace(" ", "%20"))
            with system.open_input_stream(path) as f:
                found.append(f.read())
        yield pdf.assign(content=pd.Series(found, index=pdf.index, dtype=object))


def with_content(files: DataFrame) -> DataFrame:
    """``files`` with the content of full_path, read by the executors."""
    return files.mapInPandas(_contents, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "content binary"]))


def nested_rules(found: DataFrame, name: str = ".gitignore") -> list[tuple[str, list[tuple[str, bool]]]]:
    """(folder, rules) of the ignore files among walked files, outer ones first; ignore files are few and small."""
    own = with_content(found.where(F.element_at(F.split("rel_path", "/"), -1) == name).select("full_path", "rel_path")).collect()  # ignore files alone
    rules = [(r["rel_path"].rpartition("/")[0], ignore_rules(bytes(r["content"]).decode("utf-8", "replace"))) for r in own]
    return sorted(rules, key=lambda r: r[0].count("/") + bool(r[0]))


def not_ignored_below(nested: list[tuple[str, list[tuple[str, bool]]]], path: str = "rel_path") -> Column:
    """Whether the last matching rule of the ignore files above a path, inner files over outer ones, does not exclude it."""
    verdict = F.lit(True)
    for folder, rules in nested:
        inside = F.lit(True) if not folder else F.col(path).startswith(folder + "/")
        below = F.expr(f"substring({path}, {len(folder) + 2 if folder else 1})")
        for regex, excludes in rules:
            verdict = F.when(inside & below.rlike(regex), F.lit(not excludes)).otherwise(verdict)
    return verdict


def walk_collection(spark: SparkSession, root: str, extensions: list[str] | None = None, patterns: str = "", failed: list[str] | None = None) -> DataFrame:
    """The files to index below a root, with nested ignore files honoured."""
    everything = list_files(spark, root, failed=failed)
    wanted = extension_allowed(extensions) & not_ignored(ignore_rules(patterns))
    return everything.where(wanted & not_ignored_below(nested_rules(everything)))


def under_failed_walk(path: str, failed: list[str], incomplete: bool = False) -> Column:
    """Whether a path lies where a walk failed, so that its absence proves nothing."""
    if incomplete or any(p in ("", ".") for p in failed):
        return F.lit(True)
    hit = F.lit(False)
    for p in failed:
        hit = hit | (F.col(path) == p) | F.col(path).startswith(p + "/")
    return hit


def read_files(files: DataFrame) -> DataFrame:
    """``files`` with content, hash, text (null where it is no UTF-8) and title; the chosen paths alone are opened."""
    df = with_content(files).withColumn("hash", F.sha2("content", 256))
    text = F.col("content").cast("string")
    return df.withColumn("text", F.when(F.is_valid_utf8(text), text)).withColumn("title", F.element_at(F.split("rel_path", "/"), -1))


def stale_sources(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, stale) of documents (doc_id, path, hash) against live files (rel_path, hash): stale where the source is gone or differs."""
    live = files.select(F.col("rel_path").alias("path"), F.col("hash").alias("_live"))
    return documents.join(live, "path", "left").select("doc_id", (~F.col("hash").eqNullSafe(F.col("_live"))).alias("stale"))


def ignore_list(texts: DataFrame) -> DataFrame:
    """(space_name, collection_name, pattern, line) of collections' ignore texts (space_name, collection_name, text)."""
    lines = texts.select("space_name", "collection_name", F.posexplode(F.split("text", "\\r?\\n")).alias("line", "pattern"))
    return lines.where((F.trim("pattern") != "") & ~F.trim("pattern").startswith("#")).withColumn("line", F.col("line").cast("bigint") + 1)


def disk_usage(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def matches_glob(path: str, pattern: str) -> bool:
    """Whether a path matches a shell pattern (multi-document requests)."""
    return fnmatch.fnmatchcase(path, pattern)
