"""Embedding near-dedup by robust-pruned flat graphs.

Vectors are dealt to the cells of a few centroids, each to every cell nearly as close as the closest, so cells overlap;
for the choice of cells the sample's mean is taken off, which spreads vectors that lie in a cone. A pair without a common
cell would not be compared, so the cells are audited first: about every ``AUDIT``-th vector (of few vectors, a thousand)
is compared with all, and the first of ``SPREADS`` is taken by which the share of linked pairs with a common cell is
``COVER``, over the pairs and in the mean over vectors; if none is wide enough, all vectors are one cell. In a cell, again, small overlapping cluster shards are formed; in each the nearest neighbours of a vector are pruned
robustly (a neighbour is dropped if one already taken is closer to it, by the factor ``ALPHA``, than the vector is);
the shards' adjacency lists are united with their reverse. Each vector is then searched for, greedily from the shards'
medoids with a beam, and the search goes on through all that lies in range until nothing new is in range. Every pair
reported is verified in double precision. The search of every ``AUDIT``-th vector is audited by brute force; below the
recall ``RECALL`` it is repeated with a beam twice as wide, at last as wide as the cell; then all pairs are compared.

A pair is counted in the first cell that both vectors share. A cell of more than ``CELL`` vectors is split into blocks,
and each pair of blocks is a group of its own: none is capped. Equal vectors are one point with a multiplicity.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without
vec_id; vectors of different length don't link. Of rows with one vec_id and different vectors, that with the least hash
stands for all. Each row is returned, its n_links counting other vec_ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, bounded_sample, column, groups_of, shuffle_partitions, small_batches
from quarry.llm.components import Forest, connected_components

LEAST = 0.9
#: Vectors of a cell's block, and of a cluster shard; neighbours kept; beam.
CELL, SHARD, DEGREE, BEAM = 4096, 384, 14, 20
ALPHA = 1.2
#: (margin, overlap): a vector is in every cell whose centroid's cosine is within the margin of the best, at most overlap of them.
SPREADS = ((0.1, 5), (0.2, 10), (0.3, 20), (0.5, 40))
#: Vectors that the centroids are fitted on, at most; and centroids (of 8 bytes a component: the broadcast's bound).
SAMPLE, CENTROIDS = 20_000, 8192
AUDIT, RECALL, COVER = 50, 0.97, 0.99
#: Components of the vectors that one pass of the cells' audit compares with all.
PROBED = 1_000_000
#: Pairs whose neighbours are looked at in one step.
STEP = 20_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
    """k centroids on the sphere (fewer if x has fewer rows)."""
    c = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(steps):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, unit(total), c)
    return c


def cells_of(x: np.ndarray, centroids: np.ndarray, margin: float, overlap: int) -> np.ndarray:
    """Rows of cells, nearest first, -1 beyond."""
    s = x @ centroids.T
    k = min(overlap, len(centroids))
    top = np.argsort(-s, 1, kind="stable")[:, :k]
    near = np.take_along_axis(s, top, 1)
    top[near < near[:, :1] - margin] = -1
    return np.pad(top, ((0, 0), (0, overlap - k)), constant_values=-1)


def pruned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Robustly pruned neighbours of each vector of a cluster shard, -1 beyond; the last two are random."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    c = min(n - 1, 3 * DEGREE)
    cand = np.argpartition(-s, c - 1, 1)[:, :c]
    own = np.take_along_axis(s, cand, 1)
    order = np.argsort(-own, 1)
    cand, d = np.take_along_axis(cand, order, 1), 1 - np.take_along_axis(own, order, 1)
    out, rows = np.full((n, DEGREE + 2), -1), np.arange(n)
    open_ = np.ones(cand.shape, bool)
    for k in range(min(DEGREE, c)):
        first = open_.argmax(1)
        some = open_[rows, first]
        pick = cand[rows, first]
        out[some, k] = pick[some]
        open_[rows, first] = False
        open_ &= ~(some[:, None] & (ALPHA * (1 - s[pick[:, None], cand]) <= d))
    out[:, DEGREE:] = rng.integers(0, n, (n, 2))
    return out


#: Where each vector's neighbours begin (one more than vectors), and all neighbours.
Graph = tuple[np.ndarray, np.ndarray]


def graph(x: np.ndarray, rng: np.random.Generator) -> tuple[Graph, np.ndarray]:
    """Adjacency lists united from overlapping shards, and the shards' medoids."""
    n = len(x)
    centroids = k_means(x, max(1, -(-2 * n // SHARD)), rng)
    of = cells_of(x, centroids, 2.0, 2)
    a, b, medoids = [], [], []
    for k in range(len(centroids)):
        members = np.flatnonzero((of == k).any(1))
        rng.shuffle(members)
        for part in np.array_split(members, max(1, -(-len(members) // (2 * SHARD)))):
            if len(part) < 2:
                continue
            medoids.append(part[(x[part] @ centroids[k]).argmax()])
            near = pruned(x[part], rng)
            i, j = np.nonzero(near >= 0)
            a.append(part[i]), b.append(part[near[i, j]])
    if not a:
        return (np.zeros(n + 1, np.int64), np.zeros(0, np.int64)), np.arange(min(n, 1))
    a, b = np.concatenate([*a, *b]), np.concatenate([*b, *a])
    key = np.unique(a.astype(np.int64) * n + b)
    a, b = key // n, key % n
    a, b = a[a != b], b[a != b]
    return (np.searchsorted(a, np.arange(n + 1)), b), np.unique(medoids)


def neighbours(adjacent: Graph, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours of the vectors ``at``, and for each its position in ``at``."""
    start, flat = adjacent
    n = start[at + 1] - start[at]
    owner = np.repeat(np.arange(len(at)), n)
    return owner, flat[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(len(owner))]


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), 100_000):
        out[k : k + 100_000] = np.einsum("ij,ij->i", x[i[k : k + 100_000]], x[j[k : k + 100_000]])
    return out


def search(x: np.ndarray, adjacent: Graph, medoids: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs with cosine LEAST or more, of those that the search meets."""
    n, rows = len(x), np.arange(len(queries))
    seen = np.zeros((len(queries), n), bool)
    seen[rows, queries] = True
    entry = (x[queries] @ x[medoids].T).argmax(1)
    ids = np.full((len(queries), beam), -1)
    sims, done = np.full(ids.shape, -2.0), np.ones(ids.shape, bool)
    # the query's own place in the graph is an entry as well as the closest medoid
    for k, first in enumerate((medoids[entry], queries)[: min(2, beam)]):
        ids[:, k], sims[:, k], done[:, k] = first, np.einsum("ij,ij->i", x[queries], x[first]), False
        seen[rows, first] = True
    hit_q, hit_x = [], []

    def meet(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = ~seen[q, v]
        key = np.unique(q[new].astype(np.int64) * n + v[new])
        q, v = key // n, key % n
        seen[q, v] = True
        s = cosines(x, queries[q], v)
        good = s >= LEAST
        hit_q.append(q[good]), hit_x.append(v[good])
        return q, v, s

    first_hits = (sims >= LEAST) & (ids >= 0) & (ids != queries[:, None])
    hit_q.append(np.nonzero(first_hits)[0]), hit_x.append(ids[first_hits])
    while True:
        best = np.where(done, -3.0, sims).argmax(1)
        active = rows[~done[rows, best]]
        if not len(active):
            break
        at = ids[active, best[active]]
        done[active, best[active]] = True
        own, near = neighbours(adjacent, at)
        q, v, s = meet(active[own], near)
        if not len(q):
            continue
        start = np.searchsorted(q, rows)
        width = int(np.diff(np.append(start, len(q))).max())
        more_i, more_s = np.full((len(queries), width), -1), np.full((len(queries), width), -2.0)
        more_i[q, np.arange(len(q)) - start[q]], more_s[q, np.arange(len(q)) - start[q]] = v, s
        all_i, all_s = np.concatenate([ids, more_i], 1), np.concatenate([sims, more_s], 1)
        all_d = np.concatenate([done, more_i < 0], 1)
        top = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
        ids, sims, done = (np.take_along_axis(t, top, 1) for t in (all_i, all_s, all_d))
    q, v = np.concatenate(hit_q), np.concatenate(hit_x)
    out_q, out_v = [q], [v]
    while len(q):  # the range expands through all that is in it
        hit_q.clear(), hit_x.clear()
        for k in range(0, len(q), STEP):
            own, near = neighbours(adjacent, v[k : k + STEP])
            meet(q[k : k + STEP][own], near)
        q, v = np.concatenate(hit_q), np.concatenate(hit_x)
        out_q.append(q), out_v.append(v)
    return queries[np.concatenate(out_q)], np.concatenate(out_v)


def pairs_in_range(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Pairs i < j of unit vectors with cosine LEAST or more, and the audited recall."""
    n, rng = len(x), np.random.default_rng(17)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1.0
    adjacent, medoids = graph(x, rng)
    audited = np.flatnonzero(ids % AUDIT == 0)
    beam = min(BEAM, n)
    while True:
        q, v = (np.concatenate(p) for p in zip(*(search(x, adjacent, medoids, np.arange(k, min(n, k + 1024)), beam) for k in range(0, n, 1024)), strict=True))
        key = np.unique(np.minimum(q, v) * np.int64(n) + np.maximum(q, v))
        i, j = key // n, key % n
        real = want = 0
        for k in audited:
            near = np.flatnonzero(x @ x[k] >= LEAST)
            near = near[near != k]
            want += len(near)
            real += len(np.intersect1d(np.minimum(near, k) * np.int64(n) + np.maximum(near, k), key))
        recall = real / want if want else 1.0
        if recall >= RECALL:
            return i, j, recall
        if beam >= n:
            hits = [np.nonzero(np.triu(x[k : k + 1024] @ x.T >= LEAST, k + 1)) for k in range(0, n, 1024)]
            return np.concatenate([h[0] + 1024 * k for k, h in enumerate(hits)]), np.concatenate([h[1] for h in hits]), 1.0
        beam = min(n, 2 * beam)


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least cell in both rows of cells."""
    big = np.iinfo(np.int64).max
    out = np.full(len(a), big)
    for k in range(a.shape[1]):
        own = a[:, k].astype(np.int64)
        out = np.minimum(out, np.where((own >= 0) & (b == own[:, None]).any(1), own, big))
    return out


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can link; one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.exists(v, lambda c: c != 0)
    one = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return one.groupBy("vec_id").agg(F.min_by("v", F.struct(F.xxhash64("v"), F.col("v"))).alias("v"))


def matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    flat = batch.column("v").combine_chunks() if isinstance(batch, pa.Table) else column(batch, "v")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def normed(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    x = matrix(batch)
    return unit(x / np.abs(x).max(1, keepdims=True))


def dealt(points: DataFrame, mean: np.ndarray, centroids: np.ndarray, margin: float, overlap: int) -> DataFrame:
    """(cell, cells, vec_id, mult, v): each point in each of its cells; v of unit length."""
    held = points.sparkSession.sparkContext.broadcast((mean, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, centroids = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = normed(batch)
            cells = np.concatenate([cells_of(unit(x[k : k + 2048] - mean), centroids, margin, overlap) for k in range(0, len(x), 2048)])
            i, j = np.nonzero(cells >= 0)
            n, d = len(i), x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells[i, j].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * overlap), pa.array(cells[i].astype(np.int32).ravel())),
                    column(batch, "vec_id").take(pa.array(i)),
                    column(batch, "mult").take(pa.array(i)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x[i].ravel())),
                ],
                names=["cell", "cells", "vec_id", "mult", "v"],
            )

    return points.mapInArrow(run, "cell int, cells array<int>, vec_id long, mult long, v array<double>")


def covers(points: DataFrame, n: int, mean: np.ndarray, centroids: np.ndarray) -> list[float]:
    """For each of SPREADS the audited share of linked pairs that have a common cell."""
    spark, d = points.sparkSession, len(mean)
    probes = points.where(F.pmod(F.xxhash64("vec_id", F.lit("audit")), F.lit(max(1, min(AUDIT, n // 1000)))) == 0).select("vec_id", "v")
    passes = -(-probes.count() * d // PROBED)
    total = np.zeros(2 + 2 * len(SPREADS))
    for k in range(passes):
        block = probes.where(F.pmod(F.xxhash64("vec_id", F.lit("pass")), F.lit(passes)) == k).toArrow()
        if not block.num_rows:
            continue
        held = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), normed(block), mean, centroids))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, probe, mean, centroids = held.value
            in_cells = [cells_of(unit(probe - mean), centroids, *spread) for spread in SPREADS]
            want, met = np.zeros(len(ids), np.int64), np.zeros((len(SPREADS), len(ids)), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, x = column(batch, "vec_id").to_numpy(), normed(batch)
                for at in range(0, len(x), 512):
                    part = x[at : at + 512]
                    i, j = np.nonzero(part @ probe.T >= LEAST)
                    other = own[at + i] != ids[j]
                    i, j = i[other], j[other]
                    want += np.bincount(j, minlength=len(ids))
                    for m, spread in enumerate(SPREADS):  # pairs with a common cell have one in all wider spreads
                        if not len(i):
                            break
                        cells = cells_of(unit(part - mean), centroids, *spread)
                        none = np.concatenate([first_shared(cells[i[c : c + 50_000]], in_cells[m][j[c : c + 50_000]]) == np.iinfo(np.int64).max for c in range(0, len(i), 50_000)])
                        met[m:] += np.bincount(j[~none], minlength=len(ids))
                        i, j = i[none], j[none]
            some = np.flatnonzero(want)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(want[some]), *(pa.array(m[some]) for m in met)], names=["p", "want", *(f"m{m}" for m in range(len(met)))])

        names = [f"m{m}" for m in range(len(SPREADS))]
        seen = points.mapInArrow(run, "p long, want long, " + ", ".join(f"{m} long" for m in names)).groupBy("p").agg(*(F.sum(c).alias(c) for c in ("want", *names)))
        sums = seen.agg(F.count("*"), F.sum("want"), *(F.sum(m) for m in names), *(F.sum(F.col(m) / F.col("want")) for m in names)).first()
        total += np.array([float(v or 0) for v in sums])
        held.destroy()
    if not total[0]:
        return [1.0] * len(SPREADS)
    s = len(SPREADS)
    return [float(min(total[2 + m] / total[1], total[2 + s + m] / total[0])) for m in range(s)]


def linked(points: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Rows (u, n, null): n links of point u found in one group; and (u, null, v): a link that joins two trees."""
    spark = points.sparkSession
    sample = bounded_sample(points.select("vec_id", "v"), SAMPLE, "vec_id").toArrow().sort_by("vec_id")
    x = normed(sample)
    mean = x.mean(0)
    centroids = k_means(unit(x - mean), min(CENTROIDS, max(1, n // 500)), np.random.default_rng(3))
    found = covers(points, n, mean, centroids) if len(centroids) > 1 else [1.0]
    margin, overlap = next((spread for spread, share in zip(SPREADS, found, strict=False) if share >= COVER), (2.0, 1))
    if overlap == 1:
        centroids = centroids[:1]
    rows = scratch.save(dealt(points, mean, centroids, margin, overlap))
    large = rows.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(F.col("count") * 2 / CELL).cast("int").alias("blocks"))  # by the centroids' bound few rows
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
    )
    groups = rows.join(F.broadcast(large), "cell", "left").withColumn("block", F.coalesce(own, F.lit(0))).withColumn("p", F.explode(pair))
    groups = groups.select(F.xxhash64("cell", "p.a", "p.b").alias("g"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), "block", "cell", "cells", "vec_id", "mult", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            g = table.column("g").to_numpy()
            for lo, hi in zip((cut := np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]))[:-1], cut[1:], strict=True):
                part = table.slice(lo, hi - lo)
                ids, mult = part.column("vec_id").to_numpy(), part.column("mult").to_numpy()
                i, j, _ = pairs_in_range(matrix(part.combine_chunks()), ids)
                cells = part.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, overlap)
                block = part.column("block").to_numpy()
                mine = first_shared(cells[i], cells[j]) == part.column("cell")[0].as_py()
                if part.column("a")[0].as_py() != part.column("b")[0].as_py():
                    mine &= block[i] != block[j]
                i, j = i[mine], j[mine]
                if not len(i):
                    continue
                links = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], names=["u", "n", "v"])
                forest = Forest()
                forest.add(ids[i], ids[j])
                u, v = forest.stars()
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(v)], names=["u", "n", "v"])

    return groups.repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g").mapInArrow(run, "u long, n long, v long")


def embedding_components(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    small_batches(spark)
    vectors = usable(rows)
    members = scratch.save(vectors)
    points = scratch.save(members.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult")))
    found = None
    for r in points.groupBy(F.size("v").alias("d")).count().collect():  # a row for each length of vectors
        part = linked(points.where(F.size("v") == r["d"]), r["count"], scratch)
        found = part if found is None else found.unionByName(part)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    if found is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = scratch.save(found)
    counts = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("n"))
    root = connected_components(found.where("v is not null").select("u", "v"), scratch)
    of = points.select("v", F.col("vec_id").alias("rep"), "mult").join(counts, F.col("rep") == F.col("u"), "left").join(root, F.col("rep") == F.col("node"), "left")
    of = members.join(of.select("v", "rep", "mult", "n", "root"), "v").select("vec_id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    return out.join(of, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
