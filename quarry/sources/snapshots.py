"""Snapshots of static roots: versions of files whose contents are stored once.

A version is a list of paths with the hash of what they hold; contents are rows keyed by that hash, so versions that
share files share rows. Of a new version only files are read whose path, time or size the version before doesn't have. A
symbolic link to a file is a file with the name of its target. Both tables change in one commit.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources import tree
from quarry.sources.store import Snapshot, Store, Work

FILES = "tier string, version string, file_path string, sha string, link string, mtime_ns long, size long"
CONTENTS = "sha string, content string"


def with_links(files: DataFrame, root: str) -> DataFrame:
    """The rows with ``link``: the target of a symbolic link, null for what is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = tree.opened(root)
        local = isinstance(system, tree.afs.LocalFileSystem)
        for batch in batches:
            paths = [f"{base}/{p}" for p in batch.column(batch.schema.get_field_index("file_path")).to_pylist()]
            links = [os.readlink(p) if local and os.path.islink(p) else None for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.string())], names=[*batch.schema.names, "link"])

    return files.mapInArrow(run, StructType([*files.schema.fields]).add("link", "string"))


def has(now: Snapshot, tier: str, version: str) -> bool:
    """Whether the version is there with all its contents."""
    if not now.exists("static_files"):
        return False
    own = now.read("static_files").where((F.col("tier") == tier) & (F.col("version") == version))
    lost = own.join(now.read("static_contents").select("sha"), "sha", "left_anti")
    return not own.isEmpty() and lost.isEmpty()


def take(store: Store, work: Work, listing: DataFrame, root: str, tier: str, version: str) -> None:
    """Stores a version of the listed files; one of the same name is replaced."""
    tx = store.begin()
    known, contents = tx.read("static_files", FILES), tx.read("static_contents", CONTENTS)
    stored = known.where(F.col("tier") == tier).join(contents.select("sha").distinct(), "sha", "left_semi")
    before = stored.groupBy("file_path", "mtime_ns", "size").agg(F.max("sha").alias("sha"))
    files = work.save(with_links(listing, root).join(before, ["file_path", "mtime_ns", "size"], "left"))
    read = tree.contents(files.where("sha is null"), root).where("content is not null")
    read = work.save(read.withColumn("sha", F.sha2("content", 512)))
    rows = files.where("sha is not null").unionByName(read.drop("content")).withColumn("version", F.lit(version))
    old = known.where((F.col("tier") == tier) & (F.col("version") == version)).select("tier", "version", "file_path")
    key = ["tier", "version", "file_path"]
    rows = work.save(rows.select("tier", "version", "file_path", "sha", "link", "mtime_ns", "size"))
    new = read.groupBy("sha").agg(F.first("content").alias("content")).join(contents.select("sha"), "sha", "left_anti")
    tx.put_all([("static_files", rows, old.unionByName(rows.select(*key)), key), ("static_contents", new, new.select("sha"), ["sha"])])
    tx.commit()


def files_of(now: Snapshot, tier: str, version: str) -> DataFrame:
    """(tier, file_path, sha, link, mtime_ns, size, content) of a version."""
    own = now.read("static_files").where((F.col("tier") == tier) & (F.col("version") == version)).drop("version")
    return own.join(now.read("static_contents"), "sha")


def one(now: Snapshot, tier: str, version: str, path: str) -> str | None:
    """One file's content, from the buckets of its two keys."""
    if not now.exists("static_files"):
        return None
    spark = now.store.spark
    key = spark.createDataFrame([(tier, version, path)], "tier string, version string, file_path string")
    row = now.read("static_files", now.buckets("static_files", key)).join(key, ["tier", "version", "file_path"], "left_semi").first()
    if row is None:
        return None
    sha = spark.createDataFrame([(row["sha"],)], "sha string")
    found = now.read("static_contents", now.buckets("static_contents", sha)).where(F.col("sha") == row["sha"]).first()
    return found["content"] if found else None


def drop(store: Store, work: Work, tier: str, version: str) -> None:
    """A version goes, and the contents that no other has."""
    tx = store.begin()
    files = tx.read("static_files", FILES)
    mine = (F.col("tier") == tier) & (F.col("version") == version)
    gone = work.save(files.where(mine))
    unused = work.save(gone.select("sha").distinct().join(files.where(~mine).select("sha"), "sha", "left_anti"))
    tx.put_all([("static_files", files.limit(0), gone.select("tier", "version", "file_path"), []), ("static_contents", tx.read("static_contents", CONTENTS).limit(0), unused, [])])
    tx.commit()
