import numpy as np
import pytest

from quarry.llm import components
from quarry.llm.common import Scratch


def slow(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["star", "path", "random", "two stars"])
def test_components(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "star":
        links = [(900, int(v)) for v in rng.permutation(1500) if v != 900]
    elif kind == "two stars":
        links = [(-5, k) for k in range(0, 1000, 2)] + [(2000, k) for k in range(1, 1000, 2)] + [(3000, 2000)]
    elif kind == "path":
        order = [int(v) for v in rng.permutation(300)]
        links = list(zip(order, order[1:]))
    else:
        links = [tuple(map(int, p)) for p in rng.integers(0, 400, (300, 2))]
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r.node: r.root for r in components.connected_components(df, scratch).collect()}
    want = slow(links)
    assert all(got.get(x, x) == r for x, r in want.items()) and set(got) <= set(want)


def test_least_of_dealt_nodes(spark):
    pairs = spark.createDataFrame([(1, k) for k in range(1000)] + [(2, 7), (3, 9), (3, 8)], "u long, v long").repartition(5)
    rows = components.with_least(pairs, 1003).collect()
    assert len(rows) == 1003 and {(r.u, r.m) for r in rows} == {(1, 0), (2, 7), (3, 8)}
