"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id go.

All positions of all texts are not sorted in one place. A string of ``LENGTH`` bytes is known by its anchor, the q-gram
with the least hash in it (the leftmost of several), so equal strings have equal anchors; a text has an anchor for
about each fifteenth byte. The q-grams of the anchors are the initial buckets:

1. Texts are dealt once to blocks of about ``BLOCK`` bytes, equal texts to one block, of which one copy goes on, with
   the smallest doc_id. For each class of anchors of a block (equal q-gram and equal bytes of all strings with that
   anchor) a hash goes to the bucket's task, packed by ranges of hashes. Buckets with one class are done.
2. A class that a smaller doc_id has elsewhere is removed as a whole. A bucket with several classes must be refined:
   the block that holds the class's smallest doc_id sends its bytes to the bucket.
3. There bucket-pointer refinement sorts the positions: buckets of 8-byte q-grams are refined by sorting on the bucket
   identifiers of later offsets (8, 16, then 18 on), each step using the identifiers that the one before has updated,
   so that sorted depth doubles to 16 and 32 and ends at 50 bytes; positions alone in their bucket leave the sort.
   Strings in one bucket at depth 50 are equal; those whose bucket has a smaller doc_id are removed.
4. The blocks mark the removed strings, and join the results to all documents by the text's hash.

A bucket with more than ``HOT`` classes (a passage in very many documents with different surroundings) is split by
strings: each block sends each of its distinct strings once, with its smallest doc_id, to a task by the string's hash.

The blocks' texts are shuffled once; the later steps read the same exchange. A worker's memory is about 40 times the
bytes of a block; a single text longer than a block makes a block of its size.

Null and empty texts have no bytes. Texts shorter than ``LENGTH`` bytes stay whole. A null doc_id is larger than all
others. Documents with one doc_id don't affect each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import byte_codes, column, documents, groups_of, id_and_text, mix64, shuffle_partitions, small_batches

LENGTH = 50
Q = 20
BLOCK = 2_500_000
HOT = 4000
LAST = 2**63 - 1

_CODES = byte_codes(23)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
U = np.uint64


class Block:
    """The distinct texts of a block in a fixed order, their anchors and the classes of these."""

    def __init__(self, table: pa.Table, length: int = LENGTH, q: int = Q) -> None:
        self.length = length
        least: dict[bytes, int] = {}
        for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True):
            doc = LAST if doc is None else doc
            if doc < least.get(text, LAST + 1):
                least[text] = doc
        keyed = sorted((hashlib.md5(t).digest(), t) for t in least)
        self.texts = [t for _, t in keyed]
        self.digests = [d for d, _ in keyed]
        self.docs = np.array([least[t] for t in self.texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self._anchors(q)

    def _anchors(self, q: int) -> None:
        n, length = len(self.data), self.length
        empty = np.zeros(0, np.int64)
        self.anchor, self.first, self.last, self.owner, self.gram, self.context = empty, empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
        if n < length:
            return
        power = np.full(n + 1, _BASE, U)
        power[0] = 1
        power = np.cumprod(power, dtype=U)
        total = np.zeros(n + 1, U)
        np.cumsum(_CODES[self.data] * power[:n], dtype=U, out=total[1:])
        power = np.full(n + 1, _INVERSE, U)
        power[0] = 1
        self._inverse = np.cumprod(power, dtype=U)
        self._total = total
        gram = self.hashes(np.arange(n - q + 1), q)
        bits = U(max(1, int(n).bit_length()))
        low = (gram >> bits << bits) | np.arange(len(gram), dtype=U)
        w, step = length - q + 1, 1
        least = low
        while 2 * step <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        size = len(low) - w + 1
        least = np.minimum(least[:size], least[w - step : w - step + size])
        at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        start = np.arange(size)
        owner = np.repeat(np.arange(len(self.texts)), np.diff(self.offsets))[:size]
        inside = start + length <= self.offsets[1:][owner]
        start, at, owner = start[inside], at[inside], owner[inside]
        if not len(at):
            return
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.anchor, self.owner, self.first = at[new], owner[new], start[new]
        self.last = np.concatenate([start[new[1:] - 1], start[-1:]])
        self.gram = gram[self.anchor]
        size = self.last - self.first + length
        self.context = mix64(self.hashes(self.first, size) + mix64(((self.anchor - self.first) * 64 + size).astype(U)))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix64((self._total[at + size] - self._total[at]) * self._inverse[at])

    def classes(self, parts: int) -> None:
        """Sorts anchors by part, q-gram, context and doc_id; numbers classes in that order."""
        part = (self.gram % U(parts)).astype(np.int64)
        high = (self.gram >> U(32)).astype(np.int64)
        doc = self.docs[self.owner]
        short = (self.context >> U(24)).astype(np.int64)  # 40 bits, within a bucket
        order = np.lexsort((doc, short, high, part))
        part, high, short, doc = part[order], high[order], short[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (part[1:] != part[:-1]) | (high[1:] != high[:-1]) | (short[1:] != short[:-1])
        head = np.flatnonzero(new)
        self.order, self.of_class = order, np.cumsum(new) - 1
        self.head, self.part, self.high, self.short, self.least = head, part[head], high[head], short[head], doc[head]

    def strings(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, doc_id) of each string of the anchors of some classes, sorted by the first and last."""
        chosen = np.zeros(len(self.head), bool)
        chosen[classes] = True
        anchors = self.order[chosen[self.of_class]]
        n = self.last[anchors] - self.first[anchors] + 1
        start = np.repeat(self.first[anchors] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        h = self.hashes(start, self.length)
        doc = np.repeat(self.docs[self.owner[anchors]], n)
        order = np.lexsort((doc, h))
        return h[order], start[order], doc[order]


def packed(*arrays: np.ndarray) -> bytes:
    """Bytes of the arrays' elements, all first bytes first, so that they compress well."""
    return zlib.compress(b"".join(np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes() for a in arrays), 1)


def unpacked(raw: bytes, n: int, *types: str) -> list[np.ndarray]:
    out, at, raw = [], 0, zlib.decompress(raw)
    for t in types:
        size = np.dtype(t).itemsize * n
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T).view(t).ravel())
        at += size
    return out


def bucket_rows(block: Block, pid: int, parts: int) -> pa.Table:
    """(part, pid, n, raw): the block's classes, packed by part."""
    block.classes(parts)
    rows = []
    own = np.unique(block.part)
    for part, a, b in zip(own, np.searchsorted(block.part, own), np.searchsorted(block.part, own, "right"), strict=True):
        doc = block.least[a:b]
        raw = packed(np.diff(block.high[a:b], prepend=0).astype("<u4"), (block.short[a:b] & 0xFFFFFFFF).astype("<u4"), (block.short[a:b] >> 32).astype("u1"), doc.astype("<i8"))
        rows.append((int(part), pid, int(b - a), raw))
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "pid", "n", "raw"])


#: What a class is told: a smaller doc_id has it elsewhere; its block sends its bytes; its bucket is hot.
SMALLER, SENDS, IS_HOT = 1, 2, 4


def judged(table: pa.Table) -> pa.Table:
    """(pid, part, n, raw): for each block the classes of a part that something is to be told about."""
    ns, pids = table.column("n").to_pylist(), table.column("pid").to_pylist()
    high, short, doc, src, idx = [], [], [], [], []
    for k, (n, raw) in enumerate(zip(ns, table.column("raw").to_pylist(), strict=True)):
        h, s0, s1, d = unpacked(raw, n, "<u4", "<u4", "u1", "<i8")
        high.append(np.cumsum(h, dtype=np.int64)), short.append(s0.astype(np.int64) | s1.astype(np.int64) << 32), doc.append(d)
        src.append(np.full(n, k)), idx.append(np.arange(n))
    high, short, doc, src, idx = (np.concatenate(x) for x in (high, short, doc, src, idx))
    order = np.lexsort((src, doc, short, high))
    high, short, doc, src, idx = (x[order] for x in (high, short, doc, src, idx))
    gram = np.ones(len(high), bool)
    gram[1:] = high[1:] != high[:-1]
    cls = gram.copy()
    cls[1:] |= short[1:] != short[:-1]
    head = np.flatnonzero(cls)
    of = np.cumsum(cls) - 1
    n_classes = np.bincount(np.cumsum(gram)[head] - 1)[np.cumsum(gram) - 1]
    told = np.where(doc > doc[head[of]], SMALLER, 0)
    told[head] |= np.where(n_classes[head] > 1, SENDS, 0)
    told |= np.where(n_classes > HOT, IS_HOT, 0)
    told[(told & SMALLER) > 0] &= SMALLER | IS_HOT
    out = []
    for k in range(len(ns)):
        mine = np.flatnonzero((src == k) & (told > 0)) if len(ns) < 4 else None
        out.append(mine)
    if len(ns) >= 4:
        some = np.flatnonzero(told)
        some = some[np.argsort(src[some], kind="stable")]
        cuts = np.searchsorted(src[some], np.arange(len(ns) + 1))
        out = [some[cuts[k] : cuts[k + 1]] for k in range(len(ns))]
    rows = [(pids[k], int(table.column("part")[0].as_py()), len(m), packed(idx[m].astype("<u4"), told[m].astype("u1"))) for k, m in enumerate(out) if len(m)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["pid", "part", "n", "raw"])


def told_of(block: Block, verdicts: pa.Table) -> np.ndarray:
    told = np.zeros(len(block.head), np.int64)
    for part, n, raw in zip(verdicts.column("part").to_pylist(), verdicts.column("n").to_pylist(), verdicts.column("raw").to_pylist(), strict=True):
        idx, flag = unpacked(raw, n, "<u4", "u1")
        told[np.searchsorted(block.part, part) + idx] = flag
    return told


CONTEXTS = "g long, pid int, id long, hot boolean, doc_id long, at int, bytes binary"


def context_rows(block: Block, pid: int, told: np.ndarray) -> pa.Table:
    """The bytes of classes whose buckets must be refined; of hot buckets the distinct strings."""
    sends = np.flatnonzero(((told & SENDS) > 0) & ((told & IS_HOT) == 0))
    anchor = block.order[block.head[sends]]
    lo, hi = block.first[anchor], block.last[anchor] + block.length
    raw = block.data.tobytes()
    g = mix64(((block.part[sends] << 32) ^ block.high[sends]).astype(U)).astype(np.int64)
    h, start, doc = block.strings(np.flatnonzero((told & IS_HOT) > 0))
    one = np.ones(len(h), bool)
    one[1:] = h[1:] != h[:-1]
    h, start, doc = h[one], start[one], doc[one]
    n, m = len(sends), len(h)
    return pa.table(
        [
            pa.array(np.concatenate([g, mix64(h).astype(np.int64)])),
            pa.array(np.full(n + m, pid, np.int32)),
            pa.array(np.concatenate([sends, h.view(np.int64)])),
            pa.array(np.arange(n + m) >= n),
            pa.array(np.concatenate([block.least[sends], doc])),
            pa.array(np.concatenate([anchor - lo, np.zeros(m, np.int64)]).astype(np.int32)),
            pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)] + [raw[a : a + block.length] for a in start.tolist()], pa.binary()),
        ],
        names=["g", "pid", "id", "hot", "doc_id", "at", "bytes"],
    )


def identifiers(key: np.ndarray) -> np.ndarray:
    """Bucket identifiers 0, 1, ... in order of the keys."""
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def refined(data: np.ndarray, end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket identifiers at depth ``length`` of all positions of ``data``, -1 where the string would pass ``end``.

    end: for each position the end of its text. Bucket-pointer refinement: see the module. Identifiers of positions
    that are alone in a bucket are not looked at again, but stay valid as identifiers of later offsets.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    gram = np.zeros(n, U)
    for k in range(8):
        gram = gram << U(8) | padded[k : k + n].astype(U)
    position = np.arange(n)
    room = end - position
    gram = np.where(room >= 8, gram, U(0))
    bucket = identifiers(gram)
    bucket[room < 8] = -1
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        count = np.bincount(bucket + 1)
        open_ = np.flatnonzero((room >= depth + step) & (bucket >= 0) & (count[bucket + 1] > 1))
        later = bucket[np.minimum(open_ + step, n - 1)] if len(open_) else open_
        key = bucket[open_] * np.int64(n + 1) + later
        # a bucket is split in place: its positions get new identifiers above all used so far
        bucket = bucket.copy()
        bucket[open_] = int(bucket.max(initial=0)) + 1 + identifiers(key)
        depth += step
        bucket[room < depth] = np.where(bucket[room < depth] >= 0, bucket[room < depth], -1)
    bucket[room < length] = -1
    return bucket


def repeated_strings(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """(pid, id, hot, mask): for rows with removed strings which ones (bit k: that which starts k bytes in)."""
    raw = table.column("bytes").combine_chunks().cast(pa.binary())
    sizes = np.array([len(x) for x in raw.to_pylist()], np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    bucket = refined(data, (start + sizes)[row], length)
    g, doc = table.column("g").to_numpy(), table.column("doc_id").to_numpy()
    at = np.flatnonzero(bucket >= 0)
    order = at[np.lexsort((doc[row[at]], bucket[at], g[row[at]]))]
    key_g, key_b, d = g[row[order]], bucket[order], doc[row[order]]
    new = np.ones(len(order), bool)
    new[1:] = (key_g[1:] != key_g[:-1]) | (key_b[1:] != key_b[:-1])
    head = np.flatnonzero(new)
    gone = order[d > d[head[np.cumsum(new) - 1]]] if len(order) else order
    mask = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(mask, row[gone], np.int64(1) << (gone - start[row[gone]]))
    some = np.flatnonzero(mask)
    return pa.table([table.column(c).combine_chunks().take(pa.array(some)) for c in ("pid", "id", "hot")] + [pa.array(mask[some])], names=["pid", "id", "hot", "mask"])


RESULT = "digest string, least long, n_removed long, n_spans long, kept_sha256 string"


def final_rows(block: Block, told: np.ndarray, found: pa.Table) -> pa.Table:
    """What is left of each of the block's texts."""
    doc = block.docs[block.owner[block.order]]
    of = block.of_class
    whole = (doc > block.least[of]) | ((told[of] & SMALLER) > 0)
    change = np.zeros(len(block.data) + 1, np.int64)
    anchors = block.order[whole]
    np.add.at(change, block.first[anchors], 1)
    np.add.at(change, block.last[anchors] + block.length, -1)
    hot = found.column("hot").to_numpy(zero_copy_only=False).astype(bool)
    ids, masks = found.column("id").to_numpy(), found.column("mask").to_numpy()
    mask = np.zeros(len(block.head), np.int64)
    np.bitwise_or.at(mask, ids[~hot], masks[~hot])
    own = np.flatnonzero((mask[of] != 0) & ~whole)
    for bit in range(block.length - Q + 1):
        starts = block.first[block.order[own]][(mask[of[own]] >> bit & 1) > 0] + bit
        np.add.at(change, starts, 1)
        np.add.at(change, starts + block.length, -1)
    h, start, d = block.strings(np.flatnonzero((told & IS_HOT) > 0))
    if len(h):
        new = np.concatenate([[True], h[1:] != h[:-1]])
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = start[(d > least) | np.isin(h, ids[hot].view(U))]
        np.add.at(change, gone, 1)
        np.add.at(change, gone + block.length, -1)
    removed = np.cumsum(change[:-1]) > 0
    rows = []
    for k, text in enumerate(block.texts):
        mine = removed[block.offsets[k] : block.offsets[k + 1]]
        if mine.any():
            kept = block.data[block.offsets[k] : block.offsets[k + 1]][~mine].tobytes()
            rows.append((block.digests[k].hex(), int(block.docs[k]), int(mine.sum()), int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        else:
            rows.append((block.digests[k].hex(), int(block.docs[k]), 0, 0, hashlib.sha256(text).hexdigest()))
    return result_table(rows)


def result_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "least", "n_removed", "n_spans", "kept_sha256"])


def distinct_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a text that the task has passed on with a doc_id no larger; so copies don't meet in one block by the thousand."""
    least: dict[bytes, int] = {}
    for batch in batches:
        keep = []
        for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            key, doc = hashlib.md5(text.encode()).digest(), LAST if doc is None else doc
            keep.append(doc < least.get(key, LAST + 1))
            if keep[-1]:
                least[key] = doc
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, total // BLOCK)
    parts = max(1, blocks)  # a part of all hashes then holds as many classes as a block, however large the corpus is
    n = shuffle_partitions(spark)
    one = rows.where(F.octet_length("text") >= LENGTH).mapInArrow(distinct_in_task, "doc_id long, text string")
    texts = one.select(F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("pid"), "doc_id", "text").repartition(min(n, blocks) if blocks < n else n, "pid")

    def send(table: pa.Table) -> pa.Table:
        return bucket_rows(Block(table), table.column("pid")[0].as_py(), parts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "part"):
            part = table.column("part").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from judged(table.slice(a, b - a)).to_batches()

    def rebuilt(table: pa.Table, verdicts: pa.Table) -> tuple[Block, np.ndarray]:
        block = Block(table)
        block.classes(parts)
        return block, told_of(block, verdicts)

    def contexts(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())], names=["g", "pid", "id", "hot", "doc_id", "at", "bytes"])
        if not table.num_rows or not verdicts.num_rows:
            return empty
        block, told = rebuilt(table, verdicts)
        return context_rows(block, table.column("pid")[0].as_py(), told)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            yield from repeated_strings(table).to_batches()

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result_table([])
        is_verdict = told.column("raw").is_valid()
        block, flags = rebuilt(table, told.filter(is_verdict))
        return final_rows(block, flags, told.filter(pa.compute.invert(is_verdict)))

    sent = texts.groupBy("pid").applyInArrow(send, "part int, pid int, n int, raw binary")
    verdicts = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(judge, "pid int, part int, n int, raw binary").repartition(n, "pid")
    context = texts.groupBy("pid").cogroup(verdicts.groupBy("pid")).applyInArrow(contexts, CONTEXTS)
    found = context.repartition(n, "g").sortWithinPartitions("g").mapInArrow(refine, "pid int, id long, hot boolean, mask long")
    told = verdicts.select("pid", "part", "n", "raw", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("hot"), F.lit(None).cast("long").alias("mask"))
    told = told.unionByName(found.select("pid", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("raw"), "id", "hot", "mask"))
    left = texts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(finish, RESULT)
    small = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("digest"), F.when(F.octet_length("text") < LENGTH, F.sha2(F.col("text").cast("binary"), 256)).alias("own"))
    out = small.join(left, "digest", "left")
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
