"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 and 1 and normalised. The exponent is bisected: the
largest (closest to the natural shares) whose weights have at least the target entropy, but no less than the smallest
at which no source is repeated more than the limit. Each bisection evaluates a grid of exponents in one aggregation,
so only the grid's few rows come to the driver, however many sources there are.

The weights are realised as budgeted block permutations. A source's tokens in the mix are its weight times the budget:
as many whole blocks (each a permutation of all its documents by keyed hash) as fit, then one more permutation up to
the rest of the budget. ``at`` is the place of a row in its source's stream, from 0 to 1; the mix is the rows in order
of ``at``, in which every stretch has the target weights.

Running sums are taken within buckets of the hash and carried over buckets, so a source with a third of all rows is
spread over tasks. Tokens are runs of characters that aren't white space. Null texts have none. A null source is a
source. Rows that agree in doc_id, source and text are one unit of the permutation; all of them are taken or none. A
source without tokens has share 0 and so no rows in the mix (its rows are all null, empty or white space); an empty
table, or one without tokens, gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, documents, whole_row

#: Target entropy as a part of the largest possible one; how often a source may be repeated; key of the permutations.
ENTROPY, REPEATS, SEED = 0.985, 4.0, "mix"
#: Exponents are multiples of 1 / STEPS; so many are evaluated at once.
STEPS, GRID = 1_000_000, 32


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \t\n\x0b\x0c\r]+")), F.lit(0)).cast("long")


def digest_of(text: Column) -> Column:
    """Texts are told apart by it; a null text counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def order_of(seed: str, block: Column, doc_id: Column, digest: Column) -> Column:
    """The permutation of a block: documents in order of this hash."""
    return F.md5(F.concat_ws(":", F.lit(seed), block.cast("string"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), digest).cast("binary"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, n_rows, n_tokens): rows that agree in the first three are one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest_of(F.col("text")).alias("digest"), n_tokens(F.col("text")).alias("n"))
    return rows.groupBy("doc_id", "source", "digest").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens"))


def evaluated(shares: DataFrame, steps: list[int], budget: float) -> dict[int, tuple[float, float]]:
    """For each exponent (in steps) the entropy of the weights and the largest repetition."""
    w = F.exp(F.col("step") / STEPS * F.ln("share"))
    grid = shares.select("share", "tokens", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    rows = grid.groupBy("step").agg(F.sum(w).alias("z"), F.sum(w * F.ln("share")).alias("m"), F.max(w / F.col("tokens")).alias("r")).collect()
    return {r["step"]: (math.log(r["z"]) - r["step"] / STEPS * r["m"] / r["z"], budget * r["r"] / r["z"]) for r in rows}


def bisected(shares: DataFrame, budget: float, holds: Callable[[float, float], bool]) -> tuple[int, int]:
    """(last step at which ``holds``, first at which it doesn't); it is taken to hold at 0, and to do so up to one step.

    The step after the last stands for "nowhere": if ``holds`` at all steps, the result is (STEPS, STEPS + 1).
    """
    lo, hi = 0, STEPS + 1
    while hi - lo > 1:
        steps = sorted({lo + (hi - lo) * k // GRID for k in range(1, GRID)} - {lo})
        ok = {a: holds(*v) for a, v in evaluated(shares, steps, budget).items()}
        hi = next((a for a in steps if not ok[a]), hi)
        lo = max([lo, *(a for a in steps if a < hi)])
    return lo, hi


def plan(unit: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, float]:
    """(source, total, blocks, rest) for each source with tokens, and the exponent."""
    scratch = scratch or Scratch(unit.sparkSession, "mixing")
    sources = scratch.save(unit.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0"))
    found = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = found["t"] or 0.0
    goal = min(float(budget) if budget is not None else total, repeats * total)
    if total == 0:
        return sources.select("source", F.col("tokens").alias("total"), F.lit(0).cast("long").alias("blocks"), F.lit(0.0).alias("rest")), 1.0
    shares = sources.withColumn("share", F.col("tokens") / F.lit(total))
    least = entropy * math.log(found["n"])
    upper, _ = bisected(shares, goal, lambda h, r: h >= least - 1e-12)
    _, lower = bisected(shares, goal, lambda h, r: r > repeats + 1e-9) if evaluated(shares, [0], goal)[0][1] > repeats + 1e-9 else (0, 0)
    alpha = min(STEPS, max(upper, lower)) / STEPS
    z = evaluated_z(shares, alpha)
    weight = F.exp(F.lit(alpha) * F.ln("share")) / F.lit(z)
    out = shares.select("source", F.col("tokens").alias("total"), F.floor(weight * F.lit(goal) + F.lit(1e-6)).alias("goal"))
    return out.select("source", "total", F.floor(F.col("goal") / F.col("total")).cast("long").alias("blocks"), (F.col("goal") % F.col("total")).cast("double").alias("rest")), alpha


def evaluated_z(shares: DataFrame, alpha: float) -> float:
    return shares.agg(F.sum(F.exp(F.lit(alpha) * F.ln("share"))).alias("z")).first()["z"]


def mixed(unit: DataFrame, sources: DataFrame, n_units: int, seed: str = SEED) -> DataFrame:
    """(doc_id, source, digest, n_rows, n_tokens, block, h, at): the rows of all blocks that are within the budget."""
    rows = unit.join(sources, unit["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
    rows = rows.withColumn("h", order_of(seed, F.col("block"), F.col("doc_id"), F.col("digest")))
    digits = max(2, math.ceil(math.log(max(1, n_units) / 5000, 16))) if n_units else 2
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    keys = ["source", "block", "bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("s"))
    before = F.sum("s").over(Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")) & (F.col("bucket") == F.col("_bucket")))
    rows = rows.withColumn("upto", F.col("within") + F.col("before")).where((F.col("block") < F.col("blocks")) | (F.col("upto") <= F.col("rest")))
    goal = F.col("blocks") * F.col("total") + F.col("rest")
    at = (F.col("block") * F.col("total") + F.col("upto") - F.col("n_tokens")) / goal
    return rows.select("doc_id", "source", "digest", "n_rows", "n_tokens", "block", "h", F.round(at, 9).alias("at"))


def mixture(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, scratch: Scratch | None = None, seed: str = SEED) -> DataFrame:
    """The rows of the mix; see the module."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    unit = scratch.save(units(docs))
    sources, _ = plan(unit, entropy, repeats, budget, scratch)
    return mixed(unit, scratch.save(sources), unit.count(), seed)


def resampled(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix has it.

    A block's permutation is cut at a hash, so a document is in a source's last block if its hash is at most the
    largest one taken: texts needn't be moved. Sources come by a join that Spark broadcasts only if they are small.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    unit = scratch.save(units(docs))
    sources, _ = plan(unit, entropy, repeats, budget, scratch)
    sources = scratch.save(sources)
    taken = mixed(unit, sources, unit.count(), seed)
    last = sources.join(taken.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "h"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("blocks")), "left")
    cut = scratch.save(last.groupBy("source", "blocks").agg(F.max("h").alias("cut")).select(F.col("source").alias("_source"), "blocks", "cut"))
    # a row is one struct, so that none of its columns can clash with those of the plan
    rows = docs.select(whole_row(docs).alias("row"))
    field = F.col("row").getField
    rows = rows.join(cut, field("source").cast("string").eqNullSafe(F.col("_source")))
    in_last = order_of(seed, F.col("blocks"), field("doc_id"), digest_of(field("text"))) <= F.col("cut")
    copies = F.col("blocks") + F.when(in_last, 1).otherwise(0)
    rows = rows.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "source", "n_tokens", "block", "at")
