"""Near duplicates among whole texts by SimHash: similarity ``LEAST`` or more of their sets of 5-word shingles.

This is the operator of ``simhash`` for a wider criterion. Words are lower-cased (A-Z) and told apart by ASCII white space,
as there; a text with fewer words is one shingle. Texts with equal sets of shingles are one point.

1. A point's fingerprint has 128 bits, majorities over its shingles' hashes. A similarity of 0.8 means some 19 differing
   bits, far more than one pigeonhole cut allows, so each fingerprint gets ``TABLES`` keys: a table reads ``SEGMENTS``
   segments of 23 bits at fixed random places and decodes each by the perfect Golay code [23, 12] to the index of the
   nearest codeword, so words with few differing bits mostly get one key. Points that share a key and differ in ``NEAR``
   bits or fewer are candidates.
2. The candidates' connected components are verified: the texts of a component meet in groups, where pairs within
   ``NEAR`` bits are compared by their exact sets, the nearest first; pairs already joined by others are left out.
3. Verified links are joined to the components that are the result.

A key's points are compared as they come from the sorted exchange; those of a key with more than ``BLOCK`` are passed on
and dealt to groups of two blocks each, all pairs of blocks. A component of more than ``SHINGLES`` shingles or
``POINTS_OF_BLOCK`` points is dealt in the same way. None is capped, and no group passes on more links than it has points; the work in a group of very many different
near copies grows with the square of their number.

The chance that a pair is found as a candidate (measured in tests/llm/test_similar.py) grows with its similarity; README has
figures. Texts without words are one point. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import Scratch, byte_codes, byte_view, column, groups_of, held_by_worker, id_and_text, mix64, shuffle_partitions, small_batches, told_apart, whole_row
from quarry.llm.components import Forest, connected_components, with_least
from quarry.llm.language_id import spans
from quarry.llm.simhash import index_of

WORDS, LEAST = 5, 0.8
TABLES, SEGMENTS = 192, 2
#: Differing bits of 128 up to which points are candidates; a similarity of 0.8 gives 19 on average, 4 more or less.
NEAR = 36
#: Points of a key that are compared as one group; shingles and points of a component's block.
BLOCK, SHINGLES, POINTS_OF_BLOCK = 2048, 1_000_000, 1024
#: Bytes of texts that are hashed in one step.
STEP = 2_000_000

_U = np.uint64
_CODES = byte_codes(31)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the offsets of each text's."""
    n = len(offsets) - 1
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    # a word ends where white space or the next text begins
    stop = ~inside
    stop[starts] |= inside[starts]
    stops = np.append(np.flatnonzero(stop), len(data))
    end = stops[np.searchsorted(stops, at, "right")]
    total = np.concatenate([[_U(0)], np.cumsum(_CODES[_LOWER[data]] * powers(_BASE, len(data) - 1), dtype=_U)])
    word = mix64((total[end] - total[at]) * powers(_INVERSE, len(data))[at] + (end - at).astype(_U))
    owner = np.searchsorted(offsets, at, "right") - 1
    of = np.searchsorted(owner, np.arange(n + 1))
    n_words = np.diff(of)
    n_shingles = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(n), n_shingles)
    begin = of[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    h = np.zeros(len(doc), _U)
    padded = np.concatenate([word, np.zeros(WORDS, _U)])
    for k in range(WORDS):
        h = mix64(h * _BASE + np.where(begin + k < of[doc + 1], padded[begin + k], _U(k + 1)))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def majorities(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints: two words of 64 bits for each text; 0 without shingles."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 2), _U)
    some = np.flatnonzero(n)
    for half, salt in enumerate((_U(0x6A09E667F3BCC909), _U(0xBB67AE8584CAA73B))):
        ones = np.zeros((len(some), 64), np.int64)
        for lo in range(0, len(h), 1 << 18):  # a text's shingles may be in several steps
            part = h[lo : lo + (1 << 18)]
            bits = np.unpackbits(mix64(part ^ salt).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            a = np.searchsorted(offsets[some + 1], lo, "right")
            b = np.searchsorted(offsets[some], lo + len(part), "left")
            ones[a:b] += np.add.reduceat(bits, np.maximum(offsets[some[a:b]] - lo, 0), axis=0, dtype=np.int64)
        out[some, half] = np.packbits(2 * ones > n[some, None], axis=1).view(">u8").astype(_U).ravel()
    return out


def set_hash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Equal for texts with equal sets of shingles."""
    total = np.concatenate([[_U(0)], np.cumsum(mix64(h + _U(0x510E527FADE682D1)), dtype=_U)])
    return mix64(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(_U))


POINTS = "doc_id long, h long, node long, a long, b long, n int"


def points(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``: doc_id, h (the text's hash), node (its set's), a, b (its fingerprint), n (shingles)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker("similar")
        for batch in batches:
            data, offsets = byte_view(column(batch, "text"))
            node, fp, size = [np.zeros(0, _U)], [np.zeros((0, 2), _U)], [np.zeros(0, np.int64)]
            for lo, hi in spans(offsets, STEP):
                h, of = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                node.append(set_hash(h, of)), fp.append(majorities(h, of)), size.append(np.diff(of))
            node, fp, size = np.concatenate(node), np.concatenate(fp), np.concatenate(size)
            cols = [column(batch, "doc_id"), column(batch, "h"), *(pa.array(x.view(np.int64)) for x in (node, fp[:, 0].copy(), fp[:, 1].copy())), pa.array(size.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "a", "b", "n"])

    return id_and_text(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, POINTS)


def places(seed: int = 9) -> np.ndarray:
    """For each table and segment the 23 bits that it reads; no bit twice in a table."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(128)[: 23 * SEGMENTS].reshape(SEGMENTS, 23) for _ in range(TABLES)])


class Keys:
    """Keys (32 bits) of fingerprints, one for each table."""

    def __init__(self) -> None:
        self.index = np.empty(1 << 23, np.int16)
        for k in range(0, 1 << 23, 1 << 17):
            self.index[k : k + (1 << 17)] = index_of(np.arange(k, k + (1 << 17)))
        self.weight = np.zeros((128, TABLES * SEGMENTS), np.float32)  # sums below 2^23 are exact
        for t, segments in enumerate(places()):
            for s, bits in enumerate(segments):
                self.weight[bits, t * SEGMENTS + s] = 1 << np.arange(23)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raw = np.stack([a, b], 1).astype(">i8").view(np.uint8).reshape(-1, 16)
        word = (np.unpackbits(raw, axis=1).astype(np.float32) @ self.weight).astype(np.int32)
        index = self.index[word].astype(np.int32).reshape(len(a), TABLES, SEGMENTS)
        key = np.broadcast_to(np.arange(TABLES, dtype=np.int32), (len(a), TABLES)).copy()
        for s in range(SEGMENTS):
            key = key << 12 | index[:, :, s]
        return key


def keyed(distinct: DataFrame) -> DataFrame:
    """(key, a, b): each fingerprint under each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held_by_worker("similar keys", Keys)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                a, b = column(part, "a").to_numpy(), column(part, "b").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys(a, b).ravel()), pa.array(np.repeat(a, TABLES)), pa.array(np.repeat(b, TABLES))], names=["key", "a", "b"])

    return distinct.select("a", "b").mapInArrow(run, "key int, a long, b long")


def distance(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    count = lambda x: np.bitwise_count(x.view(_U))
    return count(a[i] ^ a[j]) + count(b[i] ^ b[j])


def near_in_groups(end: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u > v, among values of a) that join what is near within each group; end: where a row's group ends."""
    forest, step, at, u, v = Forest(), 1, np.arange(len(a)), [], []
    while len(at := at[at + step < end[at]]):
        near = at[distance(a, b, at, at + step) <= NEAR]
        u.append(a[near]), v.append(a[near + step])
        if sum(map(len, u)) > 200_000:
            forest.add(np.concatenate(u), np.concatenate(v))
            u, v = [], []
        step += 1
    if u:
        forest.add(np.concatenate(u), np.concatenate(v))
    return forest.stars()


#: A link (u, v) of two fingerprints' first words, or (key, u, b): a fingerprint of a key with very many.
FOUND = "u long, v long, key int, b long"


def found_rows(u: np.ndarray, v: np.ndarray | None = None, key: np.ndarray | None = None, b: np.ndarray | None = None) -> pa.RecordBatch:
    some = lambda x, t: pa.nulls(len(u), t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(u), some(v, pa.int64()), some(key, pa.int32()), some(b, pa.int64())], names=["u", "v", "key", "b"])


def of_keys(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Links within the keys of a stream sorted by key; rows of keys with more than ``block`` pass through."""
    held: list[tuple[np.ndarray, ...]] = []  # the last key's rows, at most ``block``
    hot = None  # a key whose rows pass through

    def done(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        large = np.repeat(size > block, size)
        if large.any():
            yield found_rows(a[large], key=key[large], b=b[large])
            key, a, b, size = key[~large], a[~large], b[~large], size[size <= block]
        u, v = near_in_groups(np.repeat(np.cumsum(size), size), a, b)
        if len(u):
            yield found_rows(u, v)

    for batch in batches:
        new = tuple(column(batch, c).to_numpy() for c in ("key", "a", "b"))
        if hot is not None and len(new[0]):
            n = int(np.searchsorted(new[0], hot, "right"))
            if n:
                yield found_rows(new[1][:n], key=new[0][:n], b=new[2][:n])
            if n < len(new[0]):
                hot = None
            new = tuple(x[n:] for x in new)
        if not len(new[0]):
            continue
        held.append(new)
        rows = tuple(map(np.concatenate, zip(*held, strict=True)))
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if last:
            yield from done(*(x[:last] for x in rows))
        rest = tuple(x[last:] for x in rows)
        if len(rest[0]) > block:
            hot = rest[0][0]
            yield found_rows(rest[1], key=rest[0], b=rest[2])
            held = []
        else:
            held = [rest]
    if held:
        yield from done(*map(np.concatenate, zip(*held, strict=True)))


def dealt_pairs(size_of: DataFrame, rows: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with g, p, q and own: a row is in each group (p, q) of two blocks of its key that holds its block ``own``.

    size_of: (key, blocks) of all keys.
    """
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("p"), F.greatest(F.col("own"), j).alias("q")))
    out = rows.join(size_of, key).withColumn("own", own).withColumn("pq", F.explode(both))
    return out.withColumn("g", F.xxhash64(key, "pq.p", "pq.q")).withColumn("p", F.col("pq.p")).withColumn("q", F.col("pq.q")).drop("pq", "blocks")


def candidates(distinct: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(u, v): links among the first words of fingerprints (a, b) that join all that share a key and are near."""
    n = shuffle_partitions(distinct.sparkSession)
    dealt = keyed(distinct).repartition(n, "key").sortWithinPartitions("key")
    found = scratch.save(dealt.mapInArrow(lambda batches: of_keys(batches, block), FOUND))
    links, hot = found.where("v is not null").select("u", "v"), found.where("v is null").select("key", F.col("u").alias("a"), "b")
    if not hot.limit(1).count():
        return links
    sizes = hot.groupBy("key").agg(F.ceil(2 * F.count("*") / block).cast("int").alias("blocks"))
    groups = dealt_pairs(sizes, hot, "key", "a").select("g", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            g, a, b = (table.column(c).to_numpy() for c in ("g", "a", "b"))
            size = np.diff(np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)))
            u, v = near_in_groups(np.repeat(np.cumsum(size), size), a, b)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.unionByName(groups.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "u long, v long"))


def verified(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join all whose sets have similarity LEAST or more, among pairs within NEAR bits.

    across: the block of each row; only pairs of different blocks are compared. The nearest pairs come first, and a pair
    in one tree already is left out, so that of many near copies few pairs are compared by their sets.
    """
    n, size = len(node), np.array([len(s) for s in sets], np.int64)
    root, tree, pairs = np.arange(n), [[k] for k in range(n)], []
    a, b = fp[:, 0].copy().view(np.int64), fp[:, 1].copy().view(np.int64)
    for lo in range(0, n, 256):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, min(n, lo + 256)), np.arange(n), indexing="ij"))
        open_ = i < j
        if across is not None:
            open_ &= across[i] != across[j]
        i, j = i[open_], j[open_]
        d = distance(a, b, i, j)
        near = (d <= NEAR) & (np.minimum(size[i], size[j]) >= LEAST * np.maximum(size[i], size[j]))
        pairs.append(np.stack([d[near].astype(np.int64), i[near], j[near]]))
    d, i, j = np.concatenate(pairs, 1) if pairs else np.zeros((3, 0), np.int64)
    order = np.argsort(d, kind="stable")
    i, j, u, v, at, step = i[order], j[order], [], [], 0, 64
    while at < len(i):
        p, q = i[at : at + step], j[at : at + step]
        at, step = at + step, min(4096, 2 * step)
        open_ = root[p] != root[q]
        for x, y in zip(p[open_].tolist(), q[open_].tolist(), strict=True):
            if root[x] == root[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= LEAST * (len(sets[x]) + len(sets[y]) - both):
                u.append(x), v.append(y)
                keep, gone = sorted((root[x], root[y]))
                root[tree[gone]] = keep
                tree[keep] += tree[gone]
    return node[np.array(u, np.int64)], node[np.array(v, np.int64)]


def verified_links(docs: DataFrame, of: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): verified links of points. of: (doc_id, h, node, root, n), one row for each point of a component root."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    texts, _ = told_apart(texts, F.col("h"), of.select(F.col("h").alias("key")), scratch)
    own = of.select(F.col("doc_id").alias("id"), F.col("h").alias("own_h"), "node", "root").hint("merge")
    texts = texts.join(own, (F.col("h") == F.col("own_h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("root", "node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker("similar")
        seen: set[int] = set()  # repeated rows of one point
        for batch in batches:
            batch = batch.filter(pa.array([not (k in seen or seen.add(k)) for k in column(batch, "node").to_pylist()], pa.bool_()))
            data, offsets = byte_view(column(batch, "text"))
            for lo, hi in spans(offsets, STEP):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                fp = majorities(h, at).view(np.int64)
                raw = pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                cols = [column(batch, c).slice(lo, hi - lo) for c in ("root", "node")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), raw], names=["root", "node", "a", "b", "raw"])

    rows = texts.mapInArrow(sets, "root long, node long, a long, b long, raw binary")
    sizes = of.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / POINTS_OF_BLOCK)).cast("int").alias("blocks"))
    sizes = scratch.save(sizes.withColumn("blocks", F.when(F.col("blocks") <= 1, 1).otherwise(2 * F.col("blocks"))))
    groups = dealt_pairs(sizes, rows, "root", "node").select("g", "p", "q", "own", "node", "a", "b", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            g = table.column("g").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                node, a, b, block = (part.column(c).to_numpy() for c in ("node", "a", "b", "own"))
                fp = np.stack([a.view(_U), b.view(_U)], 1)
                own = [np.frombuffer(x, _U) for x in part.column("raw").to_pylist()]
                u, v = verified(node, fp, own, block if part.column("p")[0] != part.column("q")[0] else None)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return groups.repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def similar_groups(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, node, a, b, n) of all rows, and (node, root) of the points that have a near duplicate."""
    rows = scratch.save(points(docs))
    distinct = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    near = scratch.save(connected_components(candidates(distinct, scratch, block), scratch))
    # a fingerprint that several points share joins them as candidates as well
    one = rows.groupBy("node").agg(F.min(F.struct("doc_id", "h", "a", "n")).alias("r")).select("node", "r.*")
    one = scratch.save(one.join(near.withColumnRenamed("node", "a"), "a", "left"))
    alone = one.where("root is null")
    several = alone.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
    of = one.where("root is not null").unionByName(alone.join(several, "a", "left_semi").withColumn("root", F.col("a")))
    links = verified_links(docs, scratch.save(of.select("doc_id", "h", "node", "root", "n")), scratch)
    return rows, scratch.save(connected_components(links, scratch))


def similar_components(docs: DataFrame, scratch: Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, node, component_id) for each row of ``docs``: the smallest doc_id that similar texts lead to.

    A null doc_id is a row of its own; component_id is null where no row of the component has one. Rows that share a
    doc_id are one document: what one of them is similar to, all are.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar", 1)
    rows, by_node = with_roots(docs, scratch, block)
    return rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "node", "component_id")


def with_roots(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows, and (node, root, component_id) of all points."""
    rows, joined = similar_groups(docs, scratch, block)
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u <> w").select("doc_id", "u")
    if repeated.limit(1).count():
        more = rows.join(repeated, "doc_id").select("u", F.col("node").alias("v"))
        joined = scratch.save(connected_components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    none = F.lit(2**63 - 1)  # a point without doc_id
    root = scratch.save(least.join(joined, "node", "left").select("node", F.coalesce("least", none).alias("v"), F.coalesce("root", "node").alias("u")))
    ids = with_least(root, root.count(), "node")
    return rows, scratch.save(ids.select("node", F.col("u").alias("root"), F.when(F.col("m") != none, F.col("m")).alias("component_id")))


def keep_one(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group: the rows (of repeated rows, all) whose doc_id is the group's smallest.

    Of a group without any doc_id one row stays, that with the least hash; a row without doc_id goes if it is in a group
    with one. All columns stay as they are, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar", 1)
    rows, by_node = with_roots(docs, scratch)
    gone = scratch.save(rows.join(by_node, "node").where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    row = docs.select(whole_row(docs).alias("row"))
    doc_id = F.col("row").getField("doc_id").cast("long")
    perhaps, clear = told_apart(row.where(doc_id.isNotNull()), F.xxhash64(doc_id), gone.select(F.xxhash64("gone").alias("key")), scratch)
    kept = clear.unionByName(perhaps.join(gone.hint("merge"), doc_id == F.col("gone"), "left_anti")).select("row.*")
    nameless = docs.where(F.col("doc_id").cast("long").isNull())
    if not nameless.limit(1).count():
        return kept
    alone = by_node.where("component_id is null").select("node", "root")
    one = with_node(nameless).join(alone, "node").groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.unionByName(one.select("row.*"))


def with_node(docs: DataFrame) -> DataFrame:
    """(row, node): each row of ``docs`` as a struct, and its point."""
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = set_hash(*shingles(*byte_view(column(batch, "text"))))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(node.view(np.int64))], names=["row", "node"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("node", LongType())]))
