import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search, vector_index

SCHEMA = "point_id long, vector array<double>, file_path string, label int"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 12))
    rows = [(k, [float(c) for c in v], f"f{k % 50}", k % 7) for k, v in enumerate(x)]
    rows += [(9001, None, "f", 0), (9002, [0.0] * 12, "f", 0), (9003, [float("nan")] * 12, "f", 0), (9004, [1.0] * 3, "f", 0), (9005, [None] + [1.0] * 11, "f", 0)]
    rows += [(9100 + k, rows[5][1], "same", 1) for k in range(20)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def index(points, tmp_path_factory):
    return vector_index.build(points, str(tmp_path_factory.mktemp("index")), 12, cells=32)


def test_it_is_audited_and_stored(spark, points, index):
    assert vector_index.opened(spark, index.path) == index
    assert index.recall >= vector_index.RECALL and 1 <= index.probes < index.cells == 32
    assert index.points(spark).count() == 3020


def test_recall_of_other_queries(spark, points, index):
    asked = points.where("point_id % 37 = 0 and point_id < 9000")
    queries = vector_index.queries_of(asked, "point_id", "vector", 12)
    rows = asked.selectExpr("point_id AS query_id", "vector AS v")
    want = {(r.query_id, r.point_id) for r in search.batch_top_k(points.where("point_id not between 9001 and 9005"), rows, 10).collect()}
    got = {(r.query_id, r.point_id) for r in vector_index.batch_search(spark, index, queries, 10).collect()}
    assert len(want & got) >= 0.93 * len(want)
    exact = vector_index.batch_search(spark, index, queries, 10, exact=True)
    assert {(r.query_id, r.point_id) for r in exact.collect()} == want


def test_a_search_reads_its_cells_only(spark, points, index):
    query = points.where("point_id = 8").first().vector
    hits = vector_index.search(spark, index, query, 5, F.col("label") == 1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = hits.collect()
    assert got[0].point_id == 8 and got[0].score == pytest.approx(1.0) and {r.label for r in got} == {1}
    assert vector_index.search(spark, index, [0.0] * 12, 5).count() == 0
    assert vector_index.search(spark, index, [1.0] * 3, 5).count() == 0


def test_an_empty_table(spark, points, tmp_path):
    none = vector_index.build(points.limit(0), str(tmp_path), 12)
    assert vector_index.search(spark, none, [1.0] * 12, 5).count() == 0
    queries = vector_index.queries_of(points.limit(3), "point_id", "vector", 12)
    assert vector_index.batch_search(spark, none, queries, 5, exact=True).count() == 0


def test_shards_pass_on_the_best_only(spark, points, index, monkeypatch):
    """Not every pair of a point and a query; cells larger than a shard are cut, and the results stay."""
    asked = points.where("point_id % 37 = 0 and point_id < 9000")
    queries = vector_index.queries_of(asked, "point_id", "vector", 12)
    wanted = sorted((r.query_id, r.rank, r.point_id) for r in vector_index.batch_search(spark, index, queries, 10, exact=True).collect())
    seen, ranked = [], vector_index.ranked
    monkeypatch.setattr(vector_index, "ranked", lambda hits, *a: seen.append(hits.count()) or ranked(hits, *a))
    monkeypatch.setattr(vector_index, "SHARD", (60, 60), raising=False)
    got = vector_index.batch_search(spark, index, queries, 10, exact=True).collect()
    assert sorted((r.query_id, r.rank, r.point_id) for r in got) == wanted
    n_shards = vector_index.Dealt(spark, index).n
    assert n_shards > 3020 / 60 and max(seen) <= 10 * queries.count() * n_shards < 3020 * queries.count()


def test_scores_that_round_alike_rank_by_key(spark, tmp_path):
    """As the query's SQL ranks them: by the score of six digits."""
    from quarry.plans.catalogue import QUERIES

    vector = lambda c: [float(c), float(np.sqrt(1 - c * c)), *[0.0] * 62]
    rows = [(0, [1.0, *[0.0] * 63], 1), (1, vector(0.9), 2), (2, vector(0.9000002), 3), (3, vector(0.5), 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["vector_topk_indexed"](spark, str(tmp_path)).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1.0), (1, 0.9), (2, 0.9), (3, 0.5)]
