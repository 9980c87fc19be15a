"""File changes as a stream: a source whose offsets are versions of a listing.

Each time Spark asks for the latest offset the watched roots are listed; what differs from the last listing becomes the
events of the next version, in a file of the state folder, which all tasks read. Files of finished batches are
deleted. A version has ``max_events`` events at most: if more files have changed, or there are more than ``max_files`` to
keep in mind, each root concerned has one event ``overflow`` instead, and a sweep finds what has changed. Events are
paths; which tier they belong to is told by a join with the roots, see ``rooted``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarry.sources.tree import children, opened

EVENTS = "event string, src string, dest string, ts timestamp, seq long"


class Version(InputPartition):
    def __init__(self, n: int) -> None:
        self.value = n


class ChangeReader(DataSourceStreamReader):
    """Options: roots (a JSON list of paths), exclude (one of directories' names), state, max_events, max_files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["roots"])
        self.exclude = frozenset(json.loads(options.get("exclude", "[]")))
        self.state = options["state"]
        self.most, self.most_files = int(options.get("max_events", "10000")), int(options.get("max_files", "2000000"))

    def _system(self) -> tuple[afs.FileSystem, str]:
        system, base = opened(self.state)
        system.create_dir(base)
        return system, base

    def _load(self, name: str) -> Any:
        system, base = self._system()
        try:
            with system.open_input_stream(f"{base}/{name}") as f:
                return json.loads(f.read().decode())
        except FileNotFoundError:
            return None

    def _save(self, name: str, value: Any) -> None:
        """Written elsewhere and moved, so a reader finds all of it or the file before."""
        system, base = self._system()
        draft = f"{base}/{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(value).encode())
        system.move(draft, f"{base}/{name}")

    def listed(self, root: str) -> dict[str, list[int]] | None:
        """path: [time, size] of the files below a root; None if there are too many."""
        system, base = opened(root)
        out: dict[str, list[int]] = {}
        todo = [""]
        while todo:
            files, directories = children(system, base, todo.pop(), self.exclude)
            todo += directories
            out |= {p: [t, n] for p, t, n in files}
            if len(out) > self.most_files:
                return None
        return out

    def initialOffset(self) -> dict:
        """The first listing is what is known; changes from then on are events."""
        known = self._load("listing.json")
        if known is None:
            self._save("listing.json", {"version": 0, "roots": {r: self.listed(r) for r in self.roots}})
            return {"version": 0}
        return {"version": known["version"]}

    def latestOffset(self) -> dict:
        known = self._load("listing.json") or {"version": 0, "roots": {}}
        now = {r: self.listed(r) for r in self.roots}
        events: list[list] = []
        for root, files in now.items():
            before = known["roots"].get(root)
            if files is None or before is None:
                events += [["overflow", root, None]] if files is None or files else []
                continue
            found = [["modified" if p in before else "created", f"{root.rstrip('/')}/{p}", None] for p in sorted(files) if before.get(p) != files[p]]
            found += [["deleted", f"{root.rstrip('/')}/{p}", None] for p in sorted(before) if p not in files]
            events += found if len(found) <= self.most else [["overflow", root, None]]
        if not events:
            return {"version": known["version"]}
        n = known["version"] + 1
        at = time.time()
        self._save(f"events-{n:012d}.json", [[*e, at, n * (self.most + 1) * max(1, len(self.roots)) + k] for k, e in enumerate(events)])
        self._save("listing.json", {"version": n, "roots": now})
        return {"version": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Version(n) for n in range(start["version"] + 1, end["version"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for event, src, dest, at, seq in self._load(f"events-{partition.value:012d}.json") or []:
            yield event, src, dest, datetime.fromtimestamp(at, UTC), seq

    def commit(self, end: dict) -> None:
        system, base = self._system()
        for info in system.get_file_info(afs.FileSelector(base)):
            if info.base_name.startswith("events-") and int(info.base_name[7:19]) <= end["version"]:
                system.delete_file(info.path)


class ChangeSource(DataSource):
    """``spark.readStream.format("file_changes")`` after ``spark.dataSource.register(ChangeSource)``."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> ChangeReader:  # noqa: ANN001, N802
        return ChangeReader(dict(self.options))


def stream(spark: SparkSession, roots: list[str], state: str, exclude: list[str] | None = None, max_events: int = 10_000, max_files: int = 2_000_000) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    reader = spark.readStream.format("file_changes").option("roots", json.dumps(roots)).option("exclude", json.dumps(exclude or []))
    return reader.option("state", state).option("max_events", str(max_events)).option("max_files", str(max_files)).load()


def path_prefixes(path: Column) -> Column:
    """All directories above a path, and itself; of /a/b/c: /a, /a/b, /a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def rooted(paths: DataFrame, roots: DataFrame, path: str = "src") -> DataFrame:
    """The rows with ``tier`` and ``file_path``: of the first root (place, root, tier) that the path is below; else null.

    A path meets the roots by its prefixes, so it is one equi-join however many roots there are.
    """
    rows = paths.withColumn("_row", F.struct(*paths.columns)).select("_row", F.col(path).alias("_path"))
    keys = rows.select("_path").distinct().select("_path", F.explode_outer(path_prefixes(F.col("_path"))).alias("root"))
    hits = keys.join(roots.select("place", F.regexp_replace("root", "/+$", "").alias("root"), "tier"), "root")
    first = hits.groupBy("_path").agg(F.min(F.struct("place", "root", "tier")).alias("_r"))
    out = rows.join(first, "_path", "left")
    below = F.substr("_path", F.length(F.col("_r.root")) + 2)
    return out.select("_row.*", F.col("_r.tier").alias("tier"), F.when(below != "", below).alias("file_path"))
