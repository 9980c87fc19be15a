"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities of the XXH64 values of 3-word shingles. Two fingerprints within 3 bits are found
without comparing all pairs: the 64 bits are cut into four segments of 16. Of three or fewer differing bits, some
segment i has none while its follower i + 1 (cyclic) has at most one (see ``test_cycle_covers_all_errors``). A segment
is read as a word of the perfect binary Golay code [23, 12] (seven leading zeros); a word and its 23 neighbours decode
to one or six codewords, and the indices of these are its keys: two words at distance 1 or 2 share at least one key,
since a word between them decodes to one codeword. The key of a bucket is thus (i, segment i, index of a codeword near
segment i + 1). Candidates that share a bucket are verified by counting differing bits.

Texts with one fingerprint are one point of the search, so groups of copies cost nothing. A bucket with more than
``BLOCK`` points is split into blocks, each pair of which is its own group; no bucket is capped. Within a group only
the links that join two trees are passed on, at most one less than its points, and never all pairs.

Null and empty texts have fingerprint zero and are linked like any other. Repeated doc_ids are one node: their
fingerprints' components are joined by value, and each row is returned. A null doc_id is a row of its own that takes
its component from the others of its fingerprint (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, column, documents, groups_of, id_and_text, small_batches
from quarry.llm.components import Forest, connected_components

#: Points of a bucket's block; two blocks are compared in one group.
BLOCK = 2048
DISTANCE = 3
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: bytes) -> int:
    """The contract's fingerprint of a UTF-8 text; bytes.lower and bytes.split treat ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[k : k + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary())
            fps = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def remainder(word: np.ndarray) -> np.ndarray:
    """The syndrome: a 23-bit word modulo the generator."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


def golay_decoder() -> np.ndarray:
    """For each of the 2^11 syndromes the error pattern of weight 3 or less that causes it."""
    one = 1 << np.arange(23, dtype=np.int64)
    patterns = np.unique(np.concatenate([[0], (one[:, None, None] | one[None, :, None] | one[None, None, :]).ravel()]))
    table = np.zeros(2048, np.int64)
    table[remainder(patterns)] = patterns
    return table


_ERRORS = golay_decoder()


def index_of(word: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to a 23-bit word."""
    return (word ^ _ERRORS[remainder(word)]) >> 11


def segment_keys() -> np.ndarray:
    """For each 16-bit segment its keys, the distinct codeword indices of it and its neighbours; padded with -1."""
    words = np.arange(65_536, dtype=np.int64)
    near = np.stack([index_of(words), *(index_of(words ^ (1 << b)) for b in range(16))], 1)
    near.sort(1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, 1)
    return near[:, : int((near >= 0).sum(1).max())]


def bucket_keys(points: DataFrame) -> DataFrame:
    """(key, fp): the buckets of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = segment_keys()
        for batch in batches:
            fp = column(batch, "fp").to_numpy()
            for i in range(4):
                own, after = (fp >> (48 - 16 * i)) & 0xFFFF, (fp >> (48 - 16 * ((i + 1) % 4))) & 0xFFFF
                near = keys[after]
                key = (np.int64(i) << 28) | (own[:, None] << 12) | near
                yield pa.RecordBatch.from_arrays([pa.array(key[near >= 0]), pa.array(np.repeat(fp, (near >= 0).sum(1)))], names=["key", "fp"])

    return points.select("fp").mapInArrow(run, "key long, fp long")


def linked_in_groups(groups: np.ndarray, fp: np.ndarray) -> Forest:
    """Trees of the links among rows sorted by group; all rows of a group are compared, also those of one block."""
    forest, n, step = Forest(), len(fp), 1
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    end = np.append(np.flatnonzero(first)[1:], n)[np.cumsum(first) - 1]
    at, a, b = np.arange(n), [], []
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        near = np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= DISTANCE
        if near.any():
            a.append(fp[at[near]])
            b.append(fp[at[near] + step])
        if sum(map(len, a)) > 200_000:
            forest.add(np.concatenate(a), np.concatenate(b))
            a, b = [], []
        step += 1
    if a:
        forest.add(np.concatenate(a), np.concatenate(b))
    return forest


def links(points: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(u, v): links between fingerprints that join all that are within DISTANCE bits."""
    keys = scratch.save(bucket_keys(points))
    large = keys.groupBy("key").count().where(F.col("count") > block).withColumn("n", F.ceil(F.col("count") / block).cast("int"))
    large = scratch.save(large.select("key", "n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j))
    )
    dealt = keys.join(large, "key", "left").select("key", F.explode(pairs).alias("pair"), "fp")
    dealt = dealt.select(F.xxhash64("key", "pair").alias("g"), "fp")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            g = table.column("g").to_numpy()
            fp = table.column("fp").to_numpy()
            u, v = linked_in_groups(g, fp).stars()
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def components_by_value(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all rows, and (fp, root, component_id) of all fingerprints."""
    rows = scratch.save(fingerprints(docs))
    points = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = scratch.save(connected_components(links(points, scratch, block), scratch))
    # A component's id: the smallest doc_id of its fingerprints. A repeated doc_id joins the fingerprints of its rows.
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("w"), F.countDistinct("fp").alias("n")).where("u <> w")
    if repeated.limit(1).count():
        more = rows.join(repeated.select("doc_id", "u"), "doc_id").select("u", F.col("fp").alias("v"))
        joined = scratch.save(connected_components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch))
    root = points.join(joined, points.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    root = scratch.save(root)
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, root.join(ids, "root").select("fp", "root", "component_id")


def selected(rows: DataFrame, by_fp: DataFrame) -> DataFrame:
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_components(docs: DataFrame, scratch: Scratch | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    return selected(*components_by_value(docs, scratch or Scratch(docs.sparkSession, "simhash"), block))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
