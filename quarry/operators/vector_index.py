"""An inverted file over vectors: cells around centroids, as partitions of a Parquet table.

Centroids are fitted on a bounded sample; each vector is stored, as a unit vector, in the cell of its nearest centroid. A
search reads the cells nearest to its query, chosen by a filter on the partition column, so other cells' files are not
opened. Within a cell rows are sorted by file, and file_path and content_hash have Bloom filters, so filters on them skip
row groups.

How many cells a search reads is audited when the index is built: the least number for which the stated sample of
queries finds the share RECALL of what a scan finds. An exact search reads on: from a cell's radius follows what its best
vector can reach, and all cells that can reach the k-th best found so far are read as well.

Vectors that are null, zero, of another length or hold a component that is null or not finite are in no cell and
are found by no search.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.store import Files

#: Vectors that centroids are fitted on, at most; cells, at most (their centroids go to every task: 8 bytes a component).
SAMPLE, CELLS = 20_000, 1024
#: Of so many vectors one is a query of the audit, as long as there are this many at least; what it must find.
AUDIT, AUDITED, RECALL = 200, 50, 0.95
#: Points of a shard: this many at least and at most (which a task holds at once), and scores that a task makes at once.
SHARD, SCORES = (4096, 16_384), 4_000_000


@dataclass(frozen=True)
class Index:
    """The stored index: points by cell, (cell, centroid, radius), and what was audited."""

    path: str
    dim: int
    cells: int
    probes: int
    recall: float
    schema: str

    def points(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/points")

    def centroids(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells, centroids, radii and numbers of points; CELLS at most."""
        rows = sorted(spark.read.parquet(f"{self.path}/centroids").collect(), key=lambda r: r["_cell"])
        x = np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), self.dim)
        return np.array([r["_cell"] for r in rows], np.int32), x, np.array([r["radius"] for r in rows], np.float64), np.array([r["n"] for r in rows], np.int64)

    def as_json(self) -> str:
        return json.dumps(self.__dict__)


def unit(vector: Column, dim: int) -> Column:
    """The vector by its length; null if it can't be compared."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    good = (F.size(v) == dim) & (norm > 0) & (norm < float("inf"))  # a null or a NaN among them makes the norm so
    return F.when(good, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fitted(x: np.ndarray, k: int, seed: int = 7, steps: int = 8) -> np.ndarray:
    """k centroids on the sphere, fewer if there are fewer different vectors."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(steps):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def with_cells(units: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with ``_cell``, that of the nearest centroid, and ``_near``, the cosine to it."""
    schema = StructType([*units.schema.fields]).add("_cell", "integer").add("_near", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("_unit")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            s = x @ centroids.T
            best = s.argmax(1)
            new = [pa.array(best.astype(np.int32)), pa.array(np.minimum(s[np.arange(len(best)), best], 1.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_cell", "_near"])

    return units.mapInArrow(run, schema)


def build(points: DataFrame, path: str, dim: int, key: str = "point_id", vector: str = "vector", cells: int | None = None, k: int = 10) -> Index:
    """Writes the index of ``points`` below a new folder of ``path``; all columns are kept."""
    spark, path = points.sparkSession, f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    units = points.withColumn("_unit", unit(F.col(vector), dim)).where("_unit is not null")
    h = F.xxhash64(key, F.lit("sample"))
    n = units.count()
    share = min(1.0, 2 * SAMPLE / max(n, 1))  # enough to have the bounded sample, without sorting all
    sample = units.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(h).limit(SAMPLE).select("_unit").collect()
    x = np.array([r[0] for r in sample], np.float64).reshape(len(sample), dim)
    centroids = fitted(x, max(1, min(CELLS, cells or int(np.sqrt(n)), len(x)))) if len(x) else np.eye(1, dim)
    rows = with_cells(units, centroids)
    # files of one cell are written by few tasks, a large cell by several
    writer = rows.drop("_near").hint("rebalance", "_cell").sortWithinPartitions("_cell", *(c for c in ("tier", "file_path", key) if c in points.columns)).write
    for column in {"file_path", "content_hash", key} & set(points.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy("_cell").parquet(f"{path}/points")
    Files(spark).make(f"{path}/points")  # without rows there is none
    radius = rows.groupBy("_cell").agg(F.min("_near").alias("least"), F.count("*").alias("n"))
    table = spark.createDataFrame([(c, list(map(float, v))) for c, v in enumerate(centroids)], "_cell int, centroid array<double>")
    table.join(radius, "_cell").select("_cell", "centroid", F.acos("least").alias("radius"), "n").coalesce(1).write.parquet(f"{path}/centroids")
    schema = rows.drop("_near").schema.json()
    made = Index(path, dim, len(centroids), len(centroids), 1.0, schema)
    probes, recall = audited(spark, made, key, vector, k) if n else (1, 1.0)
    made = Index(path, dim, len(centroids), probes, recall, schema)
    Files(spark).create(f"{path}/_index", made.as_json())
    return made


def opened(spark: SparkSession, path: str) -> Index:
    return Index(**json.loads(Files(spark).read(f"{path}/_index")))


def queries_of(rows: DataFrame, query_id: str, vector: str, dim: int) -> DataFrame:
    return rows.select(F.col(query_id).alias("query_id"), unit(F.col(vector), dim).alias("_q")).where("_q is not null")


class Dealt:
    """How the points of an index are dealt to shards: small cells share one, cells larger than a shard are cut."""

    def __init__(self, spark: SparkSession, index: Index) -> None:
        self.cells, self.centroids, self.radius, counts = index.centroids(spark)
        size = min(SHARD[1], max(SHARD[0], -(-int(counts.sum()) // int(spark.conf.get("spark.sql.shuffle.partitions")))))
        self.cuts = -(-counts // size)
        self.first, self.n, shared, room = np.zeros(len(counts), np.int64), 0, 0, 0
        for c, n in enumerate(counts.tolist()):
            if n > size:
                self.first[c], self.n = self.n, self.n + int(self.cuts[c])
                continue
            if n > room:
                shared, room, self.n = self.n, size, self.n + 1
            self.first[c], room = shared, room - n
        self.members = [np.flatnonzero((self.first <= s) & (s < self.first + self.cuts)) for s in range(self.n)]

    def shard(self, key: str) -> Column:
        """The shard of a row with ``_cell``; the rows of a cell that is cut go by their keys."""
        top = int(self.cells.max(initial=0)) + 1
        first, cuts = np.zeros(top, np.int64), np.ones(top, np.int64)
        first[self.cells], cuts[self.cells] = self.first, self.cuts
        of_cell = lambda x: F.lit(x.tolist())[F.col("_cell")]
        return (of_cell(first) + F.pmod(F.xxhash64(key, F.lit("shard")), of_cell(cuts))).cast("int")


def slack(digits: int) -> float:
    """By how much a score may be less than another and rank with it once rounded, and more than the sums' error."""
    return 10.0**-digits + 1e-9


def paired(queries: DataFrame, dealt: Dealt, first: int, last: int, digits: int = 9) -> DataFrame:
    """(shard, query_id, _q, cells, kth) of queries (query_id, _q): the cells from the first to the last nearest, counted from
    0, in each shard that has any of them.

    With a column kth, only those that can hold a vector of at least this cosine: the nearest vector of a cell is no nearer
    than the angle to its centroid less its radius.
    """
    x, radius, cells, members = dealt.centroids, dealt.radius, dealt.cells, dealt.members
    has_bound = "kth" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            ids, own = (batch.column(batch.schema.get_field_index(n)) for n in ("query_id", "_q"))
            near = np.clip(own.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ x.T, -1, 1)
            need = np.zeros(near.shape, bool)
            np.put_along_axis(need, np.argsort(-near, 1, kind="stable")[:, first:last], True, 1)
            kth = np.full(batch.num_rows, np.nan)
            if has_bound:
                kth = batch.column(batch.schema.get_field_index("kth")).to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.cos(np.maximum(0, np.arccos(near) - radius))
                need &= ~(reach < kth[:, None] - slack(digits))  # no bound (NaN) keeps all
            for s, here in enumerate(members):
                rows = np.flatnonzero(need[:, here].any(1))
                if not len(rows):
                    continue
                asked, at = need[np.ix_(rows, here)], pa.array(rows)
                ends = np.concatenate([[0], np.cumsum(asked.sum(1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells[here[np.nonzero(asked)[1]]]))
                columns = [pa.array(np.full(len(rows), s, np.int32)), ids.take(at), own.take(at), lists, pa.array(kth[rows])]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "query_id", "_q", "cells", "kth"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(run, f"shard int, query_id {kind}, _q array<double>, cells array<int>, kth double")


def kth_at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row a number that k of its scores reach: the k-th largest, or for long rows that of the maxima of parts."""
    n, parts = scores.shape[1], 16 * k
    if n >= 2 * parts:
        scores, n = scores[:, : n // parts * parts].reshape(len(scores), n // parts, parts).max(1), parts
    return np.partition(scores, n - k, 1)[:, n - k]


class Shard:
    """The points of a shard, by cell; queries pass by in blocks."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, digits: int) -> None:
        """``batches``: (key, _unit, _cell), in order of key."""
        self.k, self.digits = k, digits
        points = pa.Table.from_batches(batches).combine_chunks()
        self.keys, vectors, cells = (pa.concat_arrays(c.chunks) for c in points.columns)
        cells = cells.to_numpy()
        self.place = np.argsort(cells, kind="stable")  # among the keys
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)
        self.units, self.cells = x[self.place], cells[self.place]
        self.by_component = np.ascontiguousarray(self.units.T)
        names, starts = np.unique(self.cells, return_index=True)
        self.at = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True), strict=True))

    def near(self, units: np.ndarray, lists: pa.ListArray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, points, scores): for each query the k best points of its cells, ties by key.

        Products of blocks tell which points may be among them; only these are scored one by one, always summed in the same
        order, so that equal vectors have equal scores.
        """
        bound, spare = np.where(np.isnan(kth), -np.inf, kth), slack(self.digits)
        asked = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(units)), np.diff(lists.offsets.to_numpy()))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        order = np.argsort(asked, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(asked[order])) + 1):
            if not len(own) or int(asked[own[0]]) not in self.at:
                continue
            (lo, hi), rows = self.at[int(asked[own[0]])], owner[own]
            scores = units[rows] @ self.units[lo:hi].T
            if hi - lo >= self.k:
                bound[rows] = np.maximum(bound[rows], kth_at_least(scores, self.k))
            a, b = np.nonzero(scores >= bound[rows, None] - spare)
            found.append((rows[a], b + lo, scores[a, b]))
        rows, points, about = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = about >= bound[rows] - spare
        rows, points = rows[keep], points[keep]
        scores = np.zeros(len(rows))
        for q, p in zip(np.ascontiguousarray(units.T), self.by_component, strict=True):
            scores += q[rows] * p[points]
        best = np.lexsort((self.place[points], -np.round(scores, self.digits), rows))
        rows, points, scores = rows[best], points[best], scores[best]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        return rows[first], points[first], scores[first]

    def hits(self, batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Of queries (query_id, _q, cells, kth) the rows (query_id, key, score, _cell)."""
        step = max(1, SCORES // len(self.cells))
        for part in (batch.slice(lo, step) for lo in range(0, batch.num_rows, step)):
            ids, vectors, lists, kth = part.columns
            units = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            rows, points, scores = self.near(units, lists, kth.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), self.keys.take(pa.array(self.place[points])), pa.array(scores), pa.array(self.cells[points])], names=names)


def scored(points: DataFrame, pairs: DataFrame, dealt: Dealt, k: int, key: str, digits: int = 9) -> DataFrame:
    """(query_id, key, score, _cell, rank): the k best of the paired cells for each query.

    A shard is a task's work: it holds its points, of which there are SHARD at most, and the queries pass by, so a task's
    memory depends on neither table. Each passes on k rows a query.
    """
    null = lambda name, frame: F.lit(None).cast(frame.schema[name].dataType)
    own = points.select(dealt.shard(key).alias("shard"), F.lit(0).alias("kind"), F.col(key).alias("key"), null("query_id", pairs).alias("query_id"), "_unit", "_cell", null("cells", pairs).alias("cells"), null("kth", pairs).alias("kth"))
    asked = pairs.select("shard", F.lit(1).alias("kind"), null(key, points).alias("key"), "query_id", F.col("_q").alias("_unit"), F.lit(None).cast("int").alias("_cell"), "cells", "kth")
    rows = own.unionByName(asked).repartitionById(max(1, dealt.n), "shard").sortWithinPartitions("shard", "kind", "key")
    names = ["query_id", key, "score", "_cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, shard = None, None
        for batch in batches:
            place, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if place[lo] != at:
                    at, held, shard = place[lo], [], None
                if kinds[lo] == 0:
                    held.append(part.select(["key", "_unit", "_cell"]))
                elif held:
                    shard = shard or Shard(held, k, digits)
                    yield from shard.hits(part.select(["query_id", "_unit", "cells", "kth"]), names)

    kinds = [pairs.schema["query_id"].dataType.simpleString(), points.schema[key].dataType.simpleString()]
    return ranked(rows.mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double, _cell int"), k, key, digits)


def ranked(hits: DataFrame, k: int, key: str, digits: int = 9) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), key))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def audited(spark: SparkSession, index: Index, key: str, vector: str, k: int) -> tuple[int, float]:
    """(probes, recall): the least number of cells, doubled from 1, that finds the share RECALL of what all cells hold.

    All cells are searched once. What a search of fewer finds of it follows from the place, among the query's cells, of
    the cell that each hit is in: the best of all are the best of the cells that hold them.
    """
    points, dealt = index.points(spark), Dealt(spark, index)
    n = points.count()
    one_in = max(1, min(AUDIT, n // AUDITED))
    asked = points.where(F.pmod(F.xxhash64(key, F.lit("audit")), F.lit(one_in)) == 0).select(F.col(key).alias("query_id"), F.col("_unit").alias("_q"))
    truth = scored(points, paired(asked, dealt, 0, index.cells), dealt, k, key).select("query_id", "_cell")
    x, cells = dealt.centroids, dealt.cells

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            near = np.clip(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ x.T, -1, 1)
            place = np.argsort(np.argsort(-near, 1, kind="stable"), 1)
            own = np.searchsorted(cells, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(place[np.arange(len(own)), own].astype(np.int32))], names=["place"])

    rows = truth.join(asked, "query_id").select("_q", "_cell").mapInArrow(places, "place int").groupBy("place").count().collect()  # cells at most
    found = np.zeros(index.cells, np.int64)
    for r in rows:
        found[r["place"]] = r["count"]
    wanted, probes = int(found.sum()), 1
    while probes < index.cells:
        if found[:probes].sum() >= RECALL * wanted:
            return probes, float(found[:probes].sum() / max(wanted, 1))
        probes *= 2
    return index.cells, 1.0


def search(spark: SparkSession, index: Index, query: list[float], k: int, where: Column | None = None, probes: int | None = None, key: str = "point_id") -> DataFrame:
    """The rows of the k nearest in the nearest cells with their score; the cells are a filter on the partitions."""
    q = np.array(query, np.float64)
    norm = np.linalg.norm(q)
    points = index.points(spark)
    points = points if where is None else points.where(where)
    if len(q) != index.dim or not np.isfinite(norm) or norm == 0:
        return points.limit(0).withColumn("score", F.lit(0.0))
    q = q / norm
    cells, x, _, _ = index.centroids(spark)
    near = cells[np.argsort(-(x @ q), kind="stable")][: probes or index.probes]
    hits = points.where(F.col("_cell").isin([int(c) for c in near])).withColumn("score", dot(F.col("_unit"), F.lit([float(v) for v in q])))
    return hits.orderBy(F.desc("score"), key).limit(k)


def batch_search(spark: SparkSession, index: Index, queries: DataFrame, k: int, key: str = "point_id", exact: bool = False, digits: int = 9) -> DataFrame:
    """(query_id, key, score, rank) of many queries (query_id, _q): by the audited number of cells, or exactly.

    Points rank by their score rounded to ``digits``, ties by key.
    """
    points, dealt = index.points(spark), Dealt(spark, index)
    first = scored(points, paired(queries, dealt, 0, index.probes, digits), dealt, k, key, digits).drop("_cell")
    if not exact or index.probes >= index.cells:
        return first
    first = first.drop("rank").persist()  # k rows a query, read for the bound and for the result
    bound = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    pairs = paired(queries.join(bound, "query_id", "left"), dealt, index.probes, index.cells, digits)
    more = scored(points, pairs, dealt, k, key, digits).drop("_cell", "rank")
    return ranked(first.unionByName(more), k, key, digits)
