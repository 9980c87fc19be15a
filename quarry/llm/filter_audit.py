"""What each of five filters removes in every order of applying them, with exact duplicates by partition refinement.

Filters A to D look at one text (few words, few distinct words, many capitals, marks); E removes copies of a text with a
smaller doc_id, whatever the other filters do. Copies are found by refinement: rows are split by their number of code
points, then by the hash of one block of their text after the other (blocks grow sixteenfold), and rows that are alone in
their class are dropped after each split. The rows that are dropped are told by a bitmap of bounded size, so a class of any
size stays where it is. Whole texts are compared among the survivors only: by grouping, which a copy leaves as the same
group on every machine, so each task passes on one text of a group. Classes that then hold several texts (colliding
hashes) are split by text. What follows works on 32 masks of failures for each part.

Null texts are empty, null sources are the part ''. A row without doc_id is never a copy and makes none; of rows that agree
in doc_id and text neither is smaller, so neither is a copy. A document is good or toxic if one of its labels says so.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm.common import Scratch, column, documents, small_batches, told_apart
from quarry.llm.components import with_least

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: First code points of the blocks: 64 points, then fifteen times as many as lie before; the last ends beyond any string.
STARTS = [0, *(64 * 16**k for k in range(7))]
NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
NO_MARKS = bytes(b for b in range(256) if chr(b) not in "#$%&*|")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text) of any table with doc_id, source and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII spaces, as these are bytes
    fails = [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(raw.translate(None, NO_CAPITALS)) > 2 * len(text),
        len(raw.translate(None, NO_MARKS)) > 0,
    ]
    return sum(1 << k for k, c in enumerate(fails) if c)


def block_hashes(text: str, bits: int) -> list[int]:
    """The hash of each block of a text; an empty text has one empty block."""
    ends = [*STARTS[1:], None]
    blocks = (text[a:b] for a, b in zip(STARTS, ends, strict=True) if a < max(1, len(text)))
    return [xxh3_64_intdigest(x.encode()) >> (64 - bits) for x in blocks]


def looked_at(texts: DataFrame, bits: int) -> DataFrame:
    """(doc_id, part, whole, mask, points, hashes) of (doc_id, part, text): one look at each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, points, hashes = [], [], []
            for value in column(batch, "text"):  # one text at a time is a Python string
                text = value.as_py()
                masks.append(failures(text))
                points.append(len(text))
                hashes.append([h - (1 << 63) for h in block_hashes(text, bits)])
            new = [pa.array(masks, pa.int32()), pa.array(points, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("doc_id", "part", "whole")] + new, names=["doc_id", "part", "whole", "mask", "points", "hashes"])

    return texts.withColumn("whole", whole_hash(bits)).mapInArrow(run, "doc_id long, part string, whole long, mask int, points long, hashes array<long>")


def whole_hash(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - bits) if bits < 64 else F.xxhash64("text")


def refined(key: Column, k: int) -> Column:
    """The class after the split by the k-th block; rows without such a block stay."""
    return F.when(F.size("hashes") > k, F.xxhash64(key, F.get("hashes", F.lit(k)))).otherwise(key)


def mark_copies(docs: DataFrame, scratch: Scratch, bits: int = 64) -> DataFrame:
    """(doc_id, part, mask): a row for each row of ``docs``, with the bits of all filters that it fails.

    bits: of the hashes; whatever they are, the result is the same.
    """
    small_batches(docs.sparkSession)
    texts = texts_of(docs)
    rows = scratch.save(looked_at(texts, bits).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("points"))))
    alone, k, n_blocks = [], 0, 0
    while True:
        classes = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
        rows, dropped = told_apart(rows, F.col("key"), scratch.save(classes.where("n > 1").select("key")), scratch)
        alone.append(dropped.select("whole", "doc_id", "part", "mask"))
        if k == 0:
            n_blocks = rows.agg(F.max(F.size("hashes"))).first()[0] or 0
        if k >= n_blocks:
            break
        rows = scratch.save(rows.withColumn("key", refined(F.col("key"), k)))
        k += 1
    survivors = scratch.save(rows.select("whole", "doc_id", "part", "mask"))

    # whole texts, of the survivors alone: which of their hashes stand for several texts
    texts = texts.where("doc_id is not null").withColumn("whole", whole_hash(bits))
    known = scratch.save(survivors.select(F.col("whole").alias("key")).distinct())
    same, _ = told_apart(texts, F.col("whole"), known, scratch)
    several = same.groupBy("whole", "text").agg(F.count("*").alias("n")).groupBy("whole").agg(F.count("*").alias("n")).where("n > 1")
    several = scratch.save(several.select(F.col("whole").alias("key")))
    kept, marked = survivors, []
    if several.count():  # all rows of such hashes are marked by text, those that were alone in their class too
        kept, *alone = (x.join(several, (F.col("whole") == F.col("key")) & F.col("doc_id").isNotNull(), "left_anti") for x in (survivors, *alone))
        mixed, _ = told_apart(texts, F.col("whole"), several, scratch)
        least = mixed.groupBy("whole", "text").agg(F.min("doc_id").alias("least"))
        mixed = mixed.join(several, F.col("whole") == F.col("key"), "left_semi").join(least, ["whole", "text"]).select("doc_id", "part", "text", "least")
        again = looked_at(mixed.select(F.col("doc_id"), F.to_json(F.struct("part", "least")).alias("part"), "text"), bits)
        part = F.from_json("part", "part string, least long")
        marked.append(again.select("doc_id", part["part"].alias("part"), "mask", part["least"].alias("least")))
    pairs = kept.select(F.col("whole").alias("u"), F.col("doc_id").alias("v"), "part", "mask")
    marked.append(with_least(pairs, survivors.count(), "part", "mask").select(F.col("v").alias("doc_id"), "part", "mask", F.col("m").alias("least")))
    copies = (m.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("mask")) for m in marked)
    return reduce(DataFrame.unionByName, [*(x.drop("whole") for x in alone), *copies])


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, bits: int = 64) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes and would have removed."""
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    rows = mark_copies(docs, scratch, bits).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality").alias("is_good"), has("toxic").alias("is_toxic"))
    n_if = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c.removeprefix("is_"))
    cells = rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), n_if("is_good"), n_if("is_toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    steps = parts.select("part", "cells", F.explode(F.lit(ORDERS)).alias("filter_order"))
    steps = steps.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    letter, before = F.substr("filter_order", F.col("step"), F.lit(1)), F.substr("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda s: reduce(lambda a, b: a + b, (F.when(F.instr(s, x) > 0, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)))
    steps = steps.withColumn("own", bits(letter)).withColumn("before", bits(before))
    fails = lambda m: m["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("before")) != 0
    total = lambda of, what=lambda m: m["n"]: F.aggregate(F.filter("cells", of), F.lit(0).cast("long"), lambda a, m: a + what(m))
    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # of the 120 orders, the filter comes first of the f that a document fails in 120 / f
        total(fails, lambda m: m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
