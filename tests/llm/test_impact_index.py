import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import impact_index

SCHEMA = "vec_id long, embedding array<double>"


def slow(rows, k=10, every=100):
    """All scores with Python's integers."""
    good = [(i, [max(min(math.floor(x * 1024) if math.isfinite(x * 1024) else int(math.copysign(2**63, x)), 2**63 - 1), -(2**63)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            near = sorted((-max(min(sum(a * b for a, b in zip(q, c, strict=True)), 2**63 - 1), -(2**63)), j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def run(spark, rows, parts=4, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("query", F.lit(1)).repartition(parts)
    return sorted(map(tuple, impact_index.top_k(df, F.col("vec_id") % 100 == 0, **more).drop("query").collect()))


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    x = centres[rng.integers(0, 20, n)] + spread * rng.normal(size=(n, d))
    return [(k, list(map(float, v))) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


@pytest.mark.parametrize("spread", [0.05, 1.0, 10.0])
def test_equals_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(impact_index, "SHARD", 8000)
    monkeypatch.setattr(impact_index, "BLOCK", 4)
    rows = vectors(1500, 24, 1, spread)
    assert run(spark, rows) == slow(rows)


def test_ties_copies_and_repeated_rows(spark):
    rows = [(k, [1.0, 0.5, -0.25]) for k in range(900)] + [(k, [float(k % 3), 1.0, 0.0]) for k in range(900, 1300)] + [(700, [1.0, 0.5, -0.25]), (205, [9.0, 9.0, 9.0]), (205, [9.0, 9.0, 9.0])]
    assert run(spark, rows) == slow(rows)


def test_edge_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (100, []), (7, [1.0]), (8, [-0.0001, 0.0]),
        (200, [0.0, 0.0]), (300, [1e300, -1e300]), (9, [1e300, 1.0]), (10, [-1e16, 1e16]), (-100, [-1.0, -2.0]), (400, None), (500, [3.0]),
    ]
    assert run(spark, rows) == slow(rows)
    assert run(spark, [(100, [1.0, 2.0])]) == []
    assert run(spark, []) == []


def test_reading_stops_early_on_near_copies():
    """Of clustered vectors a query reads a part of the postings, and what it keeps as possible holds the best."""
    rows = vectors(4000, 16, 3, 0.02)
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64)
    shard = impact_index.Shard(16)
    shard.add(-1, 0, 0, np.concatenate([np.arange(4000), x.ravel()]).tobytes())
    for dim, least, most, places in impact_index.segments(x):
        shard.add(dim, least, most, places.tobytes())
    shard.ready()
    kept = []
    for q in range(0, 4000, 400):
        out = np.arange(4000) == q
        can = shard.possible(x[q], out, 10)
        scores = np.where(out, -(2**62), x @ x[q])
        assert set(np.flatnonzero(scores > np.sort(scores)[-10])) <= set(can)
        kept.append(len(can))
    assert np.mean(kept) < 2400  # of 4000; from there on scoring them costs less than reading on


def test_each_segment_is_within_its_bounds():
    x = np.random.default_rng(0).integers(-500, 500, (300, 3))
    found = list(impact_index.segments(x))
    assert all((x[places, dim] >= least).all() and (x[places, dim] <= most).all() for dim, least, most, places in found)
    for dim in range(3):
        assert sorted(np.concatenate([p for d, _, _, p in found if d == dim])) == list(range(300))
