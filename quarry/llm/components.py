"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a partially aggregated minimum and a join in which the links of a node with very many are dealt to several
tasks, so no node is a group in one task. Tables between steps are written to the shared folder; their size never exceeds
the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, column


class Forest:
    """Union-find over few million long keys at most, merged in whole arrays."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.root = np.zeros(0, np.int64)

    def _index(self, ids: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(ids, self.keys)
        if len(new):
            keys = np.union1d(self.keys, new)
            root = np.arange(len(keys))
            root[np.searchsorted(keys, self.keys)] = np.searchsorted(keys, self.keys[self.root])
            self.keys, self.root = keys, root
        return np.searchsorted(self.keys, ids)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        ab = self._index(np.concatenate([a, b]))
        i, j = ab[: len(a)], ab[len(a) :]
        root = self.root
        while True:
            ri, rj = root[i], root[j]
            open_ = ri != rj
            if not open_.any():
                break
            i, j, lo, hi = i[open_], j[open_], np.minimum(ri, rj)[open_], np.maximum(ri, rj)[open_]
            np.minimum.at(root, hi, lo)
            while not np.array_equal(root, root[root]):
                root[:] = root[root]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, least key of its tree) without the roots."""
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.keys[own], self.keys[self.root[own]]


def contracted(links: DataFrame) -> DataFrame:
    """The links (u, v), each partition's reduced to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, a, b, n = Forest(), [], [], 0
        for batch in batches:
            a.append(column(batch, "u").to_numpy())
            b.append(column(batch, "v").to_numpy())
            n += batch.num_rows
            if n >= 1_000_000:
                forest.add(np.concatenate(a), np.concatenate(b))
                a, b, n = [], [], 0
        if n:
            forest.add(np.concatenate(a), np.concatenate(b))
        u, v = forest.stars()
        for k in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(v[k : k + 100_000])], names=["u", "v"])

    return links.select("u", "v").where("u <> v").mapInArrow(run, "u long, v long")


#: Links of one node that one group of the join holds at least; and nodes with more that there can be, at most, which
#: bounds the broadcast of those nodes (16 bytes each) whatever the number of links.
SPREAD, MOST = 64, 200_000


def with_least(pairs: DataFrame, n_pairs: int, *more: str) -> DataFrame:
    """(u, v, m): each pair (u, v) with the least v of its u; and more columns. n_pairs: how many there are, at most.

    A node with more than ``spread`` pairs is dealt to several groups, by its v. There are at most n_pairs / spread such
    nodes, MOST or less, so they are broadcast.
    """
    spread = max(SPREAD, -(-n_pairs // MOST))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    groups = F.ceil(F.col("n") / spread).cast("int")
    heavy = least.where(F.col("n") > spread).select("u", groups.alias("k"))
    deal = F.coalesce(F.pmod(F.xxhash64("v", F.lit("deal")), F.col("k")).cast("int"), F.lit(0))
    dealt = pairs.join(F.broadcast(heavy), "u", "left").select("u", "v", *more, deal.alias("g"))
    targets = least.select("u", "m", F.explode(F.sequence(F.lit(0), groups - 1)).alias("g"))
    return dealt.join(targets, ["u", "g"]).select("u", "v", "m", *more)


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the links (u long, v long): root is the smallest node it can reach.

    An empty table of links gives an empty table; loops and repeated links change nothing.
    """
    edges = scratch.save(contracted(links))  # u > v
    mark = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")))  # tells whether a step changed the links
    size = edges.agg(*mark).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = with_least(both, 2 * size[0]).withColumn("m", F.least("u", "m"))
        large = least.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        ends = with_least(large, 2 * size[0])
        small = ends.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = scratch.save(small.where("u <> v").distinct())
        found = new.agg(*mark).first()
        scratch.drop(edges)
        edges, done = new, found == size
        size = found
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
