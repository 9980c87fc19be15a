import numpy as np
import pytest

from quarry.llm import embedding_dedup as ed
from quarry.llm.components import Forest


def brute(ids, x):
    x = ed.unit(np.asarray(x, np.float64))
    n, forest = np.zeros(len(ids), int), Forest()
    for k in range(0, len(x), 500):
        s = x[k : k + 500] @ x.T >= 0.9
        n[k : k + 500] = s.sum(1) - 1
        i, j = np.nonzero(s)
        forest.add(ids[i + k], ids[j])
    root = dict(zip(*(a.tolist() for a in forest.stars()), strict=True))
    return n, np.array([root.get(i, i) for i in ids.tolist()])


def clustered(seed=0, groups=60, n=2400, spread=0.25):
    rng = np.random.default_rng(seed)
    base = ed.unit(rng.standard_normal((groups, 64)))
    near = ed.unit(base[rng.integers(0, groups, n // 2)] + spread * rng.standard_normal((n // 2, 64)) / 8)
    hot = ed.unit(base[0] + spread * rng.standard_normal((n // 3, 64)) / 8)
    return np.concatenate([near, hot, ed.unit(rng.standard_normal((n - n // 2 - n // 3, 64)))]).astype(np.float32)


def test_a_cell_finds_its_pairs():
    x = clustered()
    ids = np.arange(len(x))
    i, j, recall = ed.pairs_in_range(ed.unit(x.astype(np.float64)), ids)
    want = brute(ids, x)[0].sum() / 2
    assert recall >= ed.RECALL and len(i) >= 0.97 * want and (i < j).all()


@pytest.mark.parametrize("cell", [3072, 600])
def test_recall_against_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(ed, "CELL", cell)
    x = clustered(n=4800)
    ids = np.random.default_rng(1).permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, v int").repartition(3)
    got = {r.vec_id: r for r in ed.embedding_components(df).collect()}
    n, root = brute(ids, x)
    mine = np.array([got[int(i)].n_links for i in ids])
    assert (mine <= n).all() and mine.sum() >= 0.95 * n.sum()
    assert np.mean([got[int(i)].component_id == r for i, r in zip(ids, root, strict=True)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edges(spark):
    rows = [(5, [1.0, 0.0]), (7, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (6, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [0.1, 0.99])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ed.embedding_components(df).collect()), key=str)
    want = [(5, 2, 5, True), (7, 2, 5, False), (9, 2, 5, False), (9, 2, 5, False), *((k, 0, k, True) for k in (1, 2, 3, 4, 6, 8, 10)), (None, 0, None, False), (11, 1, 11, True), (12, 1, 11, False)]
    assert got == sorted(want, key=str)
    assert ed.embedding_components(df.limit(0)).count() == 0


def test_pairs_in_a_cone_share_a_cell(spark, monkeypatch):
    """Pairs at cosine 0.91 among vectors of mean cosine 0.7, with as many cells as a large table has."""
    rng, fit = np.random.default_rng(5), ed.k_means
    monkeypatch.setattr(ed, "k_means", lambda x, k, rng: fit(x, 200 if k == 16 else k, rng))
    x = ed.unit(np.sqrt(0.7) * np.eye(64)[0] + np.sqrt(0.3) * ed.unit(rng.standard_normal((8000, 64))))
    side = rng.standard_normal((4000, 64))
    side = ed.unit(side - np.einsum("ij,ij->i", side, x[:4000])[:, None] * x[:4000])
    cone = ed.unit(np.eye(64)[0] - x[:4000] * x[:4000, :1])
    side = ed.unit(0.4 * cone + side)
    side = ed.unit(side - np.einsum("ij,ij->i", side, x[:4000])[:, None] * x[:4000])
    x[4000:] = 0.91 * x[:4000] + np.sqrt(1 - 0.91**2) * side
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    n = brute(np.arange(len(x)), x)[0].sum()
    mine = sum(r.n_links for r in ed.embedding_components(df).collect())
    assert n >= 8000 and 0.97 * n <= mine <= n, (mine, n)


def test_a_group_below_its_recall_is_compared_whole(monkeypatch):
    x = ed.unit(clustered(n=600).astype(np.float64))
    monkeypatch.setattr(ed, "search", lambda x, adjacent, medoids, queries, beam: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    i, j, recall = ed.pairs_in_range(x, np.arange(len(x)))
    assert recall == 1 and len(i) == brute(np.arange(len(x)), x)[0].sum() / 2 and (i < j).all()
