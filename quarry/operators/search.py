"""Vector search: top-k with filters, batches of queries, boosts, citations, detail levels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.vectors import cosine
from quarry.operators.manifest import flag_stale

BOOST = 10.0
#: Components of the queries that go to every task at once (32 MB), and rows that are compared with them at once.
SENT, BLOCK = 4_000_000, 4096
SUMMARY = ["imports", "class", "markdown_section", "xml_element"]


def matches(filters: dict[str, object] | None) -> Column:
    """All equal; ``path`` is another name of ``file_path``, which wins if both are there."""
    filters = dict(filters or {})
    if "path" in filters:
        filters.setdefault("file_path", filters["path"])
        del filters["path"]
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in filters.items()), F.lit(True))


def lookup(points: DataFrame, filters: dict[str, object], limit: int, order: str) -> DataFrame:
    """By filter alone, in a fixed order."""
    return points.where(matches(filters)).orderBy(order).limit(limit)


def top_k(points: DataFrame, query: list[float], k: int, filters: dict[str, object] | None = None, key: str = "point_id", vector: str = "vector") -> DataFrame:
    """The k nearest by cosine, ties by key: each partition passes on k rows."""
    q = F.lit([float(x) for x in query])
    return points.where(matches(filters)).withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc_nulls_last("score"), key).limit(k)


class Nearest:
    """The k best points of each of some queries so far, by cosine, ties by key."""

    def __init__(self, ids: list[int], vectors: list[list[float]], k: int) -> None:
        self.ids, self.k = np.array(ids, np.int64), k
        sizes = np.array([len(v) for v in vectors])
        self.own = {int(n): np.flatnonzero(sizes == n) for n in set(sizes.tolist()) if n}
        self.units = {n: self._unit(np.array([vectors[i] for i in at], np.float64)) for n, at in self.own.items()}
        self.keys: list[np.ndarray] = [np.zeros(0, object)] * len(ids)
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(ids)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)

    def see(self, keys: pa.Array, vectors: pa.Array) -> None:
        sizes = np.array([len(v) if v is not None else 0 for v in vectors.to_pylist()])
        for n, at in self.own.items():
            rows = np.flatnonzero(sizes == n)
            for lo in range(0, len(rows), BLOCK):
                part = rows[lo : lo + BLOCK]
                x = self._unit(vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), n))
                names = np.array(keys.take(pa.array(part)).to_pylist(), object)
                scores = np.nan_to_num(self.units[n] @ x.T, nan=-np.inf)
                for q, score in zip(at, scores, strict=True):
                    least = self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf
                    near = np.flatnonzero((score >= least) & (score > -np.inf))
                    if len(near) > self.k:  # with all that tie
                        near = near[score[near] >= np.partition(score[near], len(near) - self.k)[len(near) - self.k]]
                    if len(near):
                        both, own = np.concatenate([self.scores[q], score[near]]), np.concatenate([self.keys[q], names[near]])
                        best = sorted(range(len(both)), key=lambda i: (-both[i], own[i]))[: self.k]  # noqa: B023
                        self.scores[q], self.keys[q] = both[best], own[best]

    def batch(self, key: str, kind: pa.DataType) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        keys = np.concatenate(self.keys).tolist() if n else []
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(keys, kind), pa.array(np.concatenate(self.scores) if n else np.zeros(0))], names=["query_id", key, "score"])


def batch_top_k(points: DataFrame, queries: DataFrame, k: int, key: str = "point_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, key, score): the k nearest points of each query (query_id, v), ties by key.

    Few queries, of SENT components at most, go to every task, which compares its rows with them in blocks and passes on
    k rows a query; so the points stay where they are. More are dealt to blocks, the points to shards, and each pair
    of both is a task's work. Null, zero and differently sized vectors are near to nothing.
    """
    spark = points.sparkSession
    kind = to_arrow_type(points.schema[key].dataType)
    schema = f"query_id long, {key} {points.schema[key].dataType.simpleString()}, score double"
    rows = points.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.size("v") > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    total = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    if total <= SENT:
        sent = asked.collect()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest([r[0] for r in sent], [r[1] for r in sent], k)
            for batch in batches:
                near.see(batch.column(0), batch.column(1))
            yield near.batch(key, kind)

        near = rows.mapInArrow(run, schema)
    else:
        n_blocks, n_shards = -(-total // SENT), int(spark.conf.get("spark.sql.shuffle.partitions"))
        # the number comes before the copies, so that all copies of a row have the same
        rows, asked = (x.withColumn("number", F.xxhash64(F.monotonically_increasing_id())) for x in (rows, asked))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        shard, block = F.pmod("number", F.lit(n_shards)).cast("int"), F.pmod("number", F.lit(n_blocks)).cast("int")
        own = rows.select(F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id"), "key", "v", shard.alias("shard"), each(n_blocks).alias("block"))
        other = asked.select(F.lit(0).alias("kind"), "query_id", F.lit(None).cast(points.schema[key].dataType).alias("key"), "v", each(n_shards).alias("shard"), block.alias("block"))
        cells = other.unionByName(own).withColumn("cell", F.col("shard") * n_blocks + F.col("block")).select("cell", "kind", "query_id", "key", "v")
        cells = cells.repartition(n_blocks * n_shards, "cell").sortWithinPartitions("cell", "kind")

        def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each cell first the queries, which are kept, then the points, which pass by."""
            at, ids, vectors, near = None, [], [], None
            for batch in batches:
                own, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    if own[lo] != at:
                        if near is not None:
                            yield near.batch(key, kind)
                        at, ids, vectors, near = own[lo], [], [], None
                    part = batch.slice(lo, hi - lo)
                    if kinds[lo] == 0:
                        ids += part.column(2).to_pylist()
                        vectors += part.column(4).to_pylist()
                    elif ids:
                        near = near or Nearest(ids, vectors, k)
                        near.see(part.column(3), part.column(4))
            if near is not None:
                yield near.batch(key, kind)

        near = cells.mapInArrow(cell, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def boosted(hits: DataFrame, refs: DataFrame, key: str = "point_id") -> DataFrame:
    """Hits that remembered notes refer to gain BOOST; the order among the others stays."""
    known = refs.select(F.col("chunk_key").alias(key)).distinct().withColumn("_hit", F.lit(True))
    return hits.join(known, key, "left").withColumn("score", F.when(F.col("_hit"), F.col("score") + BOOST).otherwise(F.col("score"))).drop("_hit")


def detail(chunk_type: Column) -> Column:
    return F.when(chunk_type.isin(SUMMARY), "summary").otherwise("source")


def citation(path: Column, line: Column, key: Column, source: Column, stale: Column) -> Column:
    body = F.concat(F.lit("[SOURCE:"), path, F.lit(":"), line.cast("string"), F.lit("]\nKey: "), key, F.lit("\n```\n"), source, F.lit("\n```"))
    return F.when(stale, F.concat(body, F.lit("\n[STALE: the file has changed since it was indexed]"))).otherwise(body)


def search(points: DataFrame, query: list[float], ledger: DataFrame, memory_refs: DataFrame, k: int = 8, filters: dict[str, object] | None = None, detail_level: str = "auto") -> DataFrame:
    """(rank, point_id, score, stale, detail, formatted). The detail level is applied after k, so fewer may remain."""
    hits = boosted(top_k(points, query, k, filters), memory_refs)
    hits = flag_stale(hits, ledger).withColumn("detail", detail(F.col("chunk_type")))
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")))  # k rows
    if detail_level != "auto":
        hits = hits.where(F.col("detail") == detail_level)
    text = citation(F.col("file_path"), F.col("line_start"), F.col("point_id"), F.col("source_text"), F.col("stale"))
    return hits.select("rank", "point_id", "score", "stale", "detail", text.alias("formatted"))
