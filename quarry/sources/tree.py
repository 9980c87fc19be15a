"""File trees listed and read by executors, by Arrow's file systems.

A listing holds no content: names, times and sizes, and excluded directories are never opened. Contents are read only for
the rows that are asked for. Spark's own readers leave out files whose name begins with an underscore, which are
modules like any other, and files without content. Symbolic links to directories are not followed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LISTED = "tier string, file_path string, mtime_ns long, size long"
#: Directories that the driver opens at most, to have enough for the tasks to go on with.
SPREAD = 64


def opened(root: str) -> tuple[afs.FileSystem, str]:
    """The file system of a root, a path or a URI, and the root's path in it."""
    if "://" in root or root.startswith("file:"):
        system, path = afs.FileSystem.from_uri(root)
        return system, path.rstrip("/")
    return afs.LocalFileSystem(), os.path.realpath(root)


def children(system: afs.FileSystem, base: str, directory: str, exclude: frozenset[str]) -> tuple[list[tuple[str, int, int]], list[str]]:
    """The files (path below the base, time, size) and the directories of a directory; a directory that is gone has none."""
    files, directories = [], []
    for info in system.get_file_info(afs.FileSelector(f"{base}/{directory}".rstrip("/") or "/", allow_not_found=True)):
        path = f"{directory}/{info.base_name}".lstrip("/")
        if info.type == afs.FileType.File:
            files.append((path, info.mtime_ns or 0, info.size or 0))
        elif info.type == afs.FileType.Directory and info.base_name not in exclude:
            linked = isinstance(system, afs.LocalFileSystem) and os.path.islink(f"{base}/{path}")
            directories += [] if linked else [path]
    return files, directories


def listing(spark: SparkSession, root: str, tier: str, exclude_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(tier, file_path, mtime_ns, size) of all files below a root. Nothing is read."""
    exclude = frozenset(exclude_dirs)
    system, base = opened(root)
    found, todo = [], [""]
    while todo and len(found) + len(todo) < SPREAD:  # until there are enough directories for the tasks
        files, directories = children(system, base, todo.pop(0), exclude)
        found += files
        todo += directories
    near = spark.createDataFrame([(tier, *f) for f in found], LISTED)
    if not todo:
        return near

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                left = [first]
                while left:
                    files, more = children(system, base, left.pop(), exclude)
                    left += more
                    if files:
                        path, time, size = (pa.array(x) for x in zip(*files, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([tier] * len(files)), path, time, size], names=["tier", "file_path", "mtime_ns", "size"])

    heads = spark.createDataFrame([(d,) for d in todo], "directory string").repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism))
    return near.unionByName(heads.mapInArrow(below, LISTED))


def contents(files: DataFrame, root: str) -> DataFrame:
    """Rows (tier, file_path, and more) with ``content``; what is no UTF-8 is replaced. A file that is gone has none (null).

    Rows that come without ``mtime_ns`` and ``size`` get them.
    """
    with_stat = "mtime_ns" not in files.columns
    schema = StructType([*files.schema.fields])
    schema = (schema.add("mtime_ns", "long").add("size", "long") if with_stat else schema).add("content", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for k, path in enumerate(batch.column(batch.schema.get_field_index("file_path")).to_pylist()):
                stat, text = [], None
                if with_stat:
                    info = system.get_file_info(f"{base}/{path}")
                    stat = [pa.array([x], pa.int64()) for x in (info.mtime_ns, info.size)]
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    pass
                # one file a batch, so that few large ones are held at once
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *stat, pa.array([text], pa.string())], names=schema.names)

    return files.mapInArrow(run, schema)


def read_one(root: str, path: str) -> str | None:
    """One file's content, for a single span; None if it is not below the root, links resolved, or is none."""
    system, base = opened(root)
    if isinstance(system, afs.LocalFileSystem) and os.path.commonpath([base, os.path.realpath(f"{base}/{path}")]) != base:
        return None
    try:
        with system.open_input_stream(f"{base}/{path}") as f:
            return f.read().decode("utf-8", "replace")
    except OSError:
        return None


def with_package_tops(files: DataFrame) -> DataFrame:
    """The files (tier, file_path) with ``package_top``: how many leading directories are no part of the module's name.

    A package's top is the first directory of the path that holds an ``__init__.py``; without one it is 0, and the whole
    path is the name. All directories of all paths meet those that hold the marker in one join.
    """
    parts = F.split("file_path", "/")
    marker = files.where(F.col("file_path").rlike(r"(^|/)__init__\.py$")).select("tier", F.regexp_replace("file_path", r"/?__init__\.py$", "").alias("directory")).distinct()
    steps = files.select("tier", "file_path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "directory"))
    tops = steps.where("depth > 0").join(marker, ["tier", "directory"]).groupBy("tier", "file_path").agg((F.min("depth") - 1).alias("package_top"))
    return files.join(tops, ["tier", "file_path"], "left").fillna(0, ["package_top"])

