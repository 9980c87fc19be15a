"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraph cells: at line ends and, so that a long line is more than one cell, before words whose
first bytes hash to 0 modulo ``CUT``. A cell's digest is 64 bits; the k-th occurrence of a digest in a text counts as a
digest of its own. A sketch of m buckets holds in each bucket the count, the xor of the digests and the xor of their
check values; each digest goes to ``HASHES`` buckets. Two versions are compared by subtracting their sketches and
peeling: a bucket with count 1 or -1 whose check value fits its digest holds one digest of one side only, which is
removed from its other buckets, and so on. If buckets remain, both are sketched again ``GROWTH`` times larger.

The likeness of two sets of digests is 1 - (digests recovered) / (digests of both), 1 for two empty ones.

``fingerprint`` (hex) is the sketch with ``BUCKETS`` buckets and the number of digests. Equal texts have equal
fingerprints. Null texts are empty; they have no digests. Rows are ordered by doc_id, then by the text's hash; a null
doc_id comes first. The document after the last is the first; an only document follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, byte_codes, byte_view, column, documents, id_and_text, mix64, shuffle_partitions, small_batches

BUCKETS = 12
HASHES = 3
GROWTH = 4
#: One word in so many begins a paragraph cell.
CUT = 6
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_cells int, changed_cells int"

_CODES = byte_codes(11)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraph cells of all texts, sorted within each text, and the offsets of each text's digests."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    line = np.concatenate([[True], data[:-1] == 10])
    starts = offsets[:-1][np.diff(offsets) > 0]
    line[starts] = before[starts] = True
    word = np.flatnonzero(before & ~space)
    room = offsets[np.searchsorted(offsets, word, "right")] - word  # bytes up to the text's end
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    first = sum((np.where(room > k, padded[word + k], 0) << np.uint64(8 * k) for k in range(1, 4)), padded[word])
    cut = line
    cut[word[mix64(first) % np.uint64(CUT) == 0]] = True
    at = np.flatnonzero(cut)
    end = np.append(at[1:], len(data))
    # a cell's digest leaves out white space at its end, so that the last cell before an edit is the same as elsewhere
    last = np.where(space, 0, np.arange(1, len(data) + 1))
    end = np.maximum(at, np.maximum.accumulate(last)[end - 1])
    full = end > at
    at, end = at[full], end[full]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[data] * powers(_BASE, len(data) - 1), dtype=np.uint64)])
    value = mix64((total[end] - total[at]) * powers(_INVERSE, len(data))[at] + (end - at).astype(np.uint64))
    owner = np.searchsorted(offsets, at, "right") - 1
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(value)) - run[np.cumsum(new) - 1]
    value = np.where(nth > 0, mix64(value + nth.astype(np.uint64) * _BASE), value)
    return value, np.searchsorted(owner, np.arange(n_docs + 1))


def checks(value: np.ndarray) -> np.ndarray:
    return (mix64(value ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


def buckets(value: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """One bucket in each of HASHES equal parts of a sketch of m."""
    part = (m // HASHES).astype(np.uint64)
    out, h = [], value
    for k in range(HASHES):
        h = mix64(h + np.uint64((k + 1) * int(_BASE) % 2**64))
        out.append((k * (m // HASHES) + (h % part).astype(np.int64)).astype(np.int64))
    return out


class Sketches:
    """Many sketches side by side; sketch i has m[i] buckets."""

    def __init__(self, m: np.ndarray) -> None:
        self.m, self.base = m, np.concatenate([[0], np.cumsum(m)])
        n = int(self.base[-1])
        self.count, self.ids, self.check = np.zeros(n, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.uint32)

    def add(self, owner: np.ndarray, value: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        check, touched = checks(value), []
        for b in buckets(value, self.m[owner]):
            at = self.base[owner] + b
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.ids, at, value)
            np.bitwise_xor.at(self.check, at, check)
            touched.append(at)
        return np.concatenate(touched) if touched else np.zeros(0, np.int64)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that can be recovered; whether each sketch is then empty."""
        owner_of = np.repeat(np.arange(len(self.m)), self.m)
        look = np.arange(len(self.count))
        owners, values, signs = [], [], []
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1)]
            pure = pure[checks(self.ids[pure]) == self.check[pure]]
            if not len(pure):
                break
            own, val = owner_of[pure], self.ids[pure]
            order = np.lexsort((val, own))
            one = np.ones(len(order), bool)  # a digest may stand alone in more than one bucket
            one[1:] = (val[order][1:] != val[order][:-1]) | (own[order][1:] != own[order][:-1])
            pick = order[one]
            own, val, sign = own[pick], val[pick], self.count[pure][pick]
            owners.append(own), values.append(val), signs.append(sign)
            look = np.unique(self.add(own, val, -sign))
        full = (self.count != 0) | (self.ids != 0) | (self.check != 0)
        empty = np.ones(len(self.m), bool)
        empty[owner_of[full]] = False
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(owners, np.int64), cat(values, np.uint64), cat(signs, np.int32), empty


def take(value: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of some texts with the position of each one's text in ``docs``."""
    n = offsets[docs + 1] - offsets[docs]
    owner = np.repeat(np.arange(len(docs)), n)
    at = np.repeat(offsets[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(owner))
    return value[at], owner


def differences(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs (text i of a, text j of b): pair, digest and side (1: a, -1: b) of each difference; and sketch sizes."""
    owners, values, signs = [], [], []
    size = np.full(len(i), BUCKETS, np.int64)
    open_ = np.arange(len(i))
    while len(open_):
        va, oa = take(*a, i[open_])
        vb, ob = take(*b, j[open_])
        sketch = Sketches(size[open_])
        sketch.add(oa, va, 1)
        sketch.add(ob, vb, -1)
        own, val, sign, empty = sketch.peel()
        good = empty[own]
        owners.append(open_[own[good]]), values.append(val[good]), signs.append(sign[good])
        open_ = open_[~empty]
        size[open_] *= GROWTH
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(owners, np.int64), cat(values, np.uint64), cat(signs, np.int32), size


def likeness(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair, _, _, _ = differences(a, i, b, j)
    changed = np.bincount(pair, minlength=len(i))
    both = np.diff(a[1])[i] + np.diff(b[1])[j]
    return np.where(both > 0, 1 - changed / np.maximum(1, both), 1.0), changed


def sketch_hex(value: np.ndarray, offsets: np.ndarray) -> list[str]:
    n = len(offsets) - 1
    s = Sketches(np.full(n, BUCKETS, np.int64))
    s.add(np.repeat(np.arange(n), np.diff(offsets)), value, 1)
    cells = np.zeros((n, BUCKETS), [("n", "<u2"), ("id", "<u8"), ("check", "<u4")])
    cells["n"], cells["id"], cells["check"] = (x.reshape(n, BUCKETS) for x in (s.count.astype(np.uint16), s.ids, s.check))
    raw, size = cells.tobytes().hex(), cells.itemsize * BUCKETS * 2
    return [f"{int(k):06x}" + raw[d * size : (d + 1) * size] for d, k in enumerate(np.diff(offsets))]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    part = following[:half]
    return text[: len(text) - half] + part


def cuts_of(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n - 1 places (key, h) that cut the rows, in that order, into parts of like size.

    They come from about 20 places for each part, picked by hash: they decide only how much a task gets, not the result.
    """
    picked = bounded_sample(rows.select("key", "h", F.xxhash64("key", "h").alias("place")), 20 * n, "place").toArrow()
    key, h = (picked[c].to_numpy() for c in ("key", "h"))
    order = np.lexsort((h, key))
    at = order[np.unique(np.arange(1, n) * len(order) // n)] if len(order) else order
    return key[at], h[at]


def bucket_of(key: np.ndarray, h: np.ndarray, cut_key: np.ndarray, cut_h: np.ndarray) -> np.ndarray:
    """How many cuts are at most (key, h)."""
    out = np.searchsorted(cut_key, key, "left")
    last = np.searchsorted(cut_key, key, "right")
    for k in np.unique(key[last > out]):  # keys that are cut, by h
        own = key == k
        lo, hi = np.searchsorted(cut_key, k, "left"), np.searchsorted(cut_key, k, "right")
        out[own] = lo + np.searchsorted(cut_h[lo:hi], h[own], "right")
    return out


def following_texts(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, key, h, text): each bucket has consecutive rows and, as its guests, the rows that come first
    in the next bucket that has any.

    Buckets are ranges of (doc_id, hash of the text), so many rows with one doc_id or without one are in several. Texts
    move once; only the buckets' first rows, one for each, move twice.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    n = max(8 * shuffle_partitions(spark), 64)
    held = spark.sparkContext.broadcast(cuts_of(rows, n))

    @F.pandas_udf("int")
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(key.to_numpy(), h.to_numpy(), *held.value))

    rows = rows.withColumn("bucket", bucket("key", "h"))
    first = rows.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("head")).select("bucket", "head.*").collect()  # n rows at most
    first.sort()
    heads = [(r["key"], r["h"], before["bucket"]) for before, r in zip([*first[-1:], *first[:-1]], first, strict=True)]
    guests = spark.createDataFrame(heads, "head_key long, head_h long, host int")
    guests = rows.join(F.broadcast(guests), (F.col("key") == F.col("head_key")) & (F.col("h") == F.col("head_h")))
    guests = guests.groupBy("host", "doc_id", "key", "h").agg(F.first("text").alias("text"))  # of equal rows one
    columns = ("doc_id", "key", "h", "text")
    return rows.select("bucket", F.lit(0).alias("guest"), *columns).unionByName(guests.select(F.col("host").alias("bucket"), F.lit(1).alias("guest"), *columns))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """See the module; one row per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = following_texts(docs)
    n = shuffle_partitions(spark) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose follower has not come yet
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(["bucket", "guest", "doc_id", "text"])
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if batch.num_rows > 1:
                yield compared(batch)
            held = batch.slice(batch.num_rows - 1)

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "key", "h").drop("key", "h").mapInArrow(run, SCHEMA)


def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Results for all rows but the last that aren't guests; each is followed by the next row."""
    texts = column(batch, "text")
    host = np.flatnonzero(column(batch, "guest").to_numpy()[:-1] == 0)
    words = texts.to_pylist()
    new = [edited(words[i], words[i + 1]) for i in host]
    own, own_edited = digests(*byte_view(texts)), digests(*byte_view(pa.array(new, pa.large_string())))
    k = np.arange(len(host))
    near, changed = likeness(own, host, own_edited, k)
    nxt, _ = likeness(own, host, own, host + 1)
    hexes = sketch_hex(*own)
    return pa.RecordBatch.from_arrays(
        [
            column(batch, "doc_id").take(pa.array(host)),
            pa.array([len(words[i]) for i in host], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array([hexes[i] for i in host], pa.string()),
            pa.array(sketch_hex(*own_edited), pa.string()),
            pa.array(near, pa.float64()),
            pa.array(nxt, pa.float64()),
            pa.array(np.diff(own[1])[host], pa.int32()),
            pa.array(changed, pa.int32()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_cells", "changed_cells"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))
