"""Exact top-k search by inner product over an index of postings in order of impact, read score at a time.

Components are integers, floor(1024 x). The vectors are dealt to shards of about ``SHARD`` components. In a shard each
dimension's values are quantised to ``LEVELS`` levels, the impacts; a posting segment is the list of the vectors of one
level with the least and the greatest value in it. Index and queries meet by shard and block of queries, so a task holds
one shard and one block, whatever their numbers. A query reads a shard's segments by descending quantised impact, that is
by what a vector of the segment can at most gain over the worst value of that dimension (for a negative weight the
lowest values come first). A vector's gains add up to what it has at least; what it can still gain is bounded, dimension by
dimension, by the largest unread impact or the width of the widest segment read. Reading stops only when it is proven
that no vector outside the possible ones can be among the best k, and these are fewer than the postings that are left;
the possible ones are then scored from their whole integer vectors. The best k of all shards are ranked.

Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id. A query is compared
with vectors of its own length (empty ones score 0). A query's own rows are all with its vec_id; of other vec_ids each
row counts, and each row that is a query has its own result. Integer components and scores saturate at the range of long.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, column, groups_of, shuffle_partitions, small_batches

SCALE, EVERY, K = 1024, 100, 10
#: Components of a shard, about; queries of a block, about; levels of a component's values; steps in which segments are read.
SHARD, BLOCK, LEVELS, STEPS = 1 << 19, 512, 32, 24
#: Vectors of one row of the index.
ROWS = 512
#: Sums below this are exact in double precision.
EXACT = 2**52
INDEX = "pid long, sub int, size int, dim int, least long, most long, members binary"


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): v holds the integer components."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def segments(x: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(dimension, least, most, places): the vectors of each level of each dimension."""
    for dim in range(x.shape[1]):
        values = x[:, dim]
        lo, hi = int(values.min()), int(values.max())
        level = ((values.astype(np.float64) - lo) * (LEVELS / (hi - lo + 1.0))).astype(np.int64)
        order = np.argsort(level, kind="stable").astype(np.int32)
        for run in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
            yield dim, int(values[run].min()), int(values[run].max()), run


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows of a task's vectors: rows of the vectors themselves (dim -1), then the posting segments."""
    pid = TaskContext.get().partitionId()
    held: dict[int, list[tuple[int, list[int]]]] = {}
    n_subs = 0

    def index(size: int) -> Iterator[pa.RecordBatch]:
        nonlocal n_subs
        rows = held.pop(size)
        ids, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), size)
        out = [(-1, 0, 0, np.concatenate([ids[k : k + ROWS], x[k : k + ROWS].ravel()])) for k in range(0, len(ids), ROWS)]
        for k, part in enumerate((out, list(segments(x)))):
            if part:
                n = len(part)
                fixed = [pa.array(np.full(n, v)) for v in (pid, np.int32(n_subs), np.int32(size))]
                dims = pa.array([p[0] for p in part], pa.int32())
                ends = [pa.array([p[k] for p in part], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*fixed, dims, *ends, pa.array([p[3].tobytes() for p in part], pa.binary())], names=["pid", "sub", "size", "dim", "least", "most", "members"])
        n_subs += 1

    for batch in batches:
        for vec_id, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "v").to_pylist(), strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((vec_id, v))
            if len(rows) * max(1, len(v)) >= 2 * SHARD:  # more than a task's share
                yield from index(len(v))
    for size in list(held):
        yield from index(size)


class Shard:
    """The vectors of one shard that have one length, and their postings."""

    def __init__(self, size: int) -> None:
        self.size, self.rows, self.runs = size, [], []

    def add(self, dim: int, least: int, most: int, members: bytes) -> None:
        if dim < 0:
            self.rows.append(np.frombuffer(members, np.int64))
        else:
            self.runs.append((dim, least, most, np.frombuffer(members, np.int32)))

    def ready(self) -> Shard:
        """With all rows added."""
        n = [len(r) // (self.size + 1) for r in self.rows]
        self.ids = np.concatenate([r[:k] for r, k in zip(self.rows, n, strict=True)])
        self.x = np.concatenate([r[k:].reshape(k, self.size) for r, k in zip(self.rows, n, strict=True)])
        self.runs.sort(key=lambda r: r[:2])
        self.dim = np.array([r[0] for r in self.runs], np.int64)
        self.least, self.most = (np.array([r[k] for r in self.runs], np.int64) for k in (1, 2))
        self.places = [r[3] for r in self.runs]
        self.lengths = np.array([len(p) for p in self.places], np.int64)
        self.first = np.flatnonzero(np.diff(self.dim, prepend=-1))  # the first segment of each dimension
        self.greatest = max((max(abs(int(r[1])), abs(int(r[2]))) for r in self.runs), default=0)
        return self

    def scores(self, q: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact scores of the vectors at the places."""
        if not self.size:
            return np.zeros(len(places), np.int64)
        if self.greatest * max(abs(int(q.max())), abs(int(q.min()))) * self.size < EXACT:
            return self.x[places] @ q
        bound = np.iinfo(np.int64)
        return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, q, strict=True)), bound.min), bound.max) for row in self.x[places]], np.int64)

    def possible(self, q: np.ndarray, out: np.ndarray, k: int) -> np.ndarray:
        """Places of all vectors that can be among the best k but for those that are out."""
        inside = np.flatnonzero(~out)
        n = len(self.ids)
        if len(inside) <= k or not self.size or self.greatest * max(abs(int(q.max())), abs(int(q.min()))) * self.size * 2 >= EXACT:
            return inside
        w = q[self.dim]
        a, b = w * self.least, w * self.most
        low, high = np.minimum(a, b), np.maximum(a, b)
        base = np.minimum.reduceat(low, self.first)[self.dim]
        gain, sure, width = high - base, (low - base).astype(np.float64), high - low
        order = np.argsort(-gain, kind="stable")
        upto = np.cumsum(self.lengths[order])
        cuts = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, STEPS + 1) / STEPS))
        has, unread, seen, done = np.zeros(n), gain.copy(), np.zeros_like(width), 0
        has[out] = -np.inf
        for cut in cuts:
            now = order[done : cut + 1]
            done = cut + 1
            has += np.bincount(np.concatenate([self.places[s] for s in now]), np.repeat(sure[now], self.lengths[now]), n)
            unread[now] = 0
            seen[now] = width[now]
            # a vector gains no more than this on what it has: unread segments, or the rest of a segment's width
            more = np.maximum(np.maximum.reduceat(unread, self.first), np.maximum.reduceat(seen, self.first)).sum()
            kth = np.partition(has, n - k)[n - k]
            can = np.flatnonzero(has >= kth - more)
            if len(can) * self.size <= upto[-1] - upto[cut]:
                break
        return can

    def best(self, vec_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k, ties to the smaller id."""
        can = self.possible(q, self.ids == vec_id, k)
        scores = self.scores(q, can)
        top = np.lexsort((self.ids[can], ~scores))[:k]  # ~ descends as - does, without overflow
        return self.ids[can][top], scores[top]


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best k of each query of a block in a shard; the rows of a cell begin with the index."""
    for cell in groups_of(batches, "cell"):
        shards: dict[int, Shard] = {}
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        ready = False
        for row in cell.to_batches():
            for kind, sub, size, dim, least, most, members in zip(*(row.column(row.schema.get_field_index(c)).to_pylist() for c in ("kind", "sub", "size", "dim", "least", "most", "members")), strict=True):
                if kind == 0:
                    shards.setdefault(sub, Shard(size)).add(dim, least, most, members)
                    continue
                if not ready:
                    shards, ready = {n: s.ready() for n, s in shards.items()}, True
                q = np.frombuffer(members, np.int64)
                out += [(least, most, *s.best(most, q, k)) for s in shards.values() if s.size == size]
        if out:
            n = [len(o[2]) for o in out]
            query, query_id = (np.repeat(np.array([o[i] for o in out], np.int64), n) for i in (0, 1))
            ids, scores = (np.concatenate([o[i] for o in out]) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(query_id), pa.array(ids), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries as rows of the index: least is the number of the row, most its vec_id."""
    for batch in batches:
        vectors = [np.array(v, np.int64) for v in column(batch, "v").to_pylist()]
        sizes, members = pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())
        yield pa.RecordBatch.from_arrays([sizes, column(batch, "query"), column(batch, "vec_id"), members], names=["size", "least", "most", "members"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """(query, query_id, rank, vec_id, score): the k best of all vectors for each row that is a query.

    query is a number of the row, so that rows of one vec_id have results of their own.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "impact-index")
    rows = usable(vectors, vec_col)
    total = rows.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    n_shards = max(1, -(-total // SHARD))
    index = scratch.save(rows.repartition(n_shards).mapInArrow(built, INDEX))
    queries = scratch.save(rows.where(is_query).withColumn("query", F.monotonically_increasing_id()).mapInArrow(as_bytes, "size int, least long, most long, members binary"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("least"), F.lit(n_blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    postings = index.select("*", F.lit(0).alias("kind"), each(n_blocks).alias("block"))
    asked = queries.select(F.lit(0).alias("sub"), "size", F.lit(0).alias("dim"), "least", "most", "members", F.lit(1).alias("kind"), block.alias("block"), each(n_shards).alias("pid"))
    cells = postings.unionByName(asked).withColumn("cell", F.col("pid") * n_blocks + F.col("block")).drop("pid", "block")
    cells = cells.repartition(max(n_shards * n_blocks, shuffle_partitions(spark)), "cell").sortWithinPartitions("cell", "kind")
    near = cells.mapInArrow(lambda batches: searched(batches, k), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0).drop("query")
