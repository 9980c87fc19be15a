import pytest

from quarry.chunkers import scripts
from quarry.chunkers.base import place
from quarry.operators import search
from quarry.plans import tables


@pytest.mark.parametrize(
    ("sql", "names"),
    [("SELECT * FROM a, b", {"a", "b"}), ("SELECT * FROM a x, b AS y, c WHERE x.i = y.i", {"a", "b", "c"}), ("SELECT * FROM a JOIN b USING (i), c", {"a", "b"}), ("SELECT f(x, y) FROM a ORDER BY b, c", {"a"})],
)
def test_tables_of_a_list(sql, names):
    assert scripts.tables(sql.replace(",", " , ").replace("(", " ( ").replace(")", " ) ").split()) >= names
    assert "b" not in scripts.tables("SELECT f ( x ) FROM a ORDER BY b , c".split())


def test_a_line_feed_belongs_to_its_line():
    assert place("one\n\ntwo\n", "one\n\ntwo\n", 0)[:2] == (1, 3)
    first = place("same\nsame\n", "same\n", 0)
    assert first[:2] == (1, 1) and place("same\nsame\n", "same\n", first[2])[:2] == (2, 2)


def test_queries_in_blocks_equal_all_at_once(spark, sf, monkeypatch):
    points, queries = tables.vectors(spark, sf), tables.query_vectors(spark, sf)
    odd = spark.createDataFrame([(-1, [1.0, 2.0]), (-2, None), (-3, [0.0] * 64), (-4, [])], "query_id long, v array<double>")
    queries = queries.selectExpr("query_id", "cast(v as array<double>) v").unionByName(odd).unionByName(queries.where("query_id = 0").selectExpr("999 AS query_id", "cast(v as array<double>) v"))
    rows = lambda: sorted((r.query_id, r.point_id, round(r.score, 9), r.rank) for r in search.batch_top_k(points, queries, 3).collect())
    want = rows()
    assert {r[0] for r in want} == {r.query_id for r in queries.where("query_id >= 0").collect()} and all(sum(x[0] == q for x in want) == 3 for q in {r[0] for r in want})
    for sent in (2 * 64, 64):
        monkeypatch.setattr(search, "SENT", sent)
        assert rows() == want
