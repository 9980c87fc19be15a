"""Vectors: cosine, checks, pooling, the deterministic hash embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_usable(v: Column, dim: int | None = None) -> Column:
    """All components finite, and ``dim`` of them; a null vector isn't usable."""
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return ok & (F.size(v) == dim) if dim is not None else ok


def quarantined(v: Column, dim: int) -> Column:
    return F.when(is_usable(v, dim), v)


def normalised(v: Column) -> Column:
    """Unit length; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def mean_pooled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): the mean of each key's vectors at unit length; pre-aggregated by position."""
    parts = rows.select(key, F.posexplode(vector).alias("pos", "x"))
    mean = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = mean.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return mean.join(size, F.col(key).eqNullSafe(F.col("_k"))).where("n > 0").select(key, "pos", (F.col("m") / F.col("n")).alias("value"))


def hash_embedding(text: Column, dim: int) -> Column:
    """Unit vector from SHA-256 blocks of the text, a zero byte and a counter: 8 bytes big-endian less 2^63 each."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 4) - 1)), lambda c: F.sha2(F.concat(text, F.lit("\u0000"), c.cast("string")).cast("binary"), 256))
    raw = F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.conv(F.substr(h, k * 16 + 1, F.lit(16)), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("double"))))
    return normalised(F.slice(raw, 1, dim))
