"""Extensions that change what is indexed, and the engine's vector index."""

import pytest
from pyspark.sql import functions as F

from quarry.api import Engine
from quarry.chunkers.markup import Claim
from quarry.config import Config, Root
from quarry.extension import Extension, Extensions, Source, Tool

FILES = {"a.py": "def pay():\n    return 1\n\n\ndef bill():\n    return 2\n", "x.xml": '<r><keep id="k">one</keep><drop id="d">two</drop></r>', "b.md": "# B\n\nText of b.\n"}


class Team(Extension):
    """Files from a table, a column of the points, XML profiles, a tool."""

    name = "team"
    log: list = []

    def __init__(self, spark):
        self.files = spark.createDataFrame([(p, c) for p, c in FILES.items()], "file_path string, content string")

    def sources(self):
        def listing(spark, root, tier, exclude):
            return self.files.select(F.lit(tier).alias("tier"), "file_path", F.lit(1).cast("long").alias("mtime_ns"), F.length("content").cast("long").alias("size"))

        return {"table": Source(listing, lambda rows, root: rows.join(self.files, "file_path", "left"))}

    def payload_columns(self):
        return {"team": F.when(F.col("file_path").startswith("a"), "one").otherwise("two"), "n_lines": F.col("line_end") - F.col("line_start") + 1}

    def xml_profiles(self):
        def claims(tag, attributes):
            return {"keep": Claim("kept", {"why": "profile"}, own_chunk=True), "drop": Claim(skip=True)}.get(tag)

        return (claims,)

    def tools(self, engine):
        return [Tool("biggest", lambda k=1: engine.points.read().orderBy(F.desc("n_lines"), "point_id").limit(k))]

    def on_startup(self, engine):
        self.log.append("up")

    def on_shutdown(self, engine):
        self.log.append("down")


def engine_of(spark, path, extensions=None):
    return Engine(spark, Config(project="demo", state_dir=str(path), roots=[Root(tier="db", path="/nowhere", source="table")], buckets=4), extensions)


def test_hooks_take_effect(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown source"):
        engine_of(spark, tmp_path).reindex()
    with engine_of(spark, tmp_path, Extensions([Team(spark)])) as engine:
        out = engine.reindex().first()
        assert (out.tier, out.indexed) == ("db", 3) and Team.log == ["up"]
        points = {r.identity: (r.chunk_type, r.team, r.n_lines) for r in engine.points.read().collect()}
        assert points["k"] == ("kept", "two", 1) and "d" not in points and points["pay"] == ("function", "one", 2)
        assert {r.formatted.split(":")[1] for r in engine.search_code("x", 10, {"team": "one"}).collect()} == {"a.py"}
        assert engine.tool("biggest").first().n_lines == 2
        assert engine.read_file("db", "b.md", 1, 1).first().text == "# B"
        with pytest.raises(ValueError, match="unknown tool"):
            engine.tool("none")
        assert not engine.rebuild_needed() and engine_of(spark, tmp_path).rebuild_needed()  # other columns, another index
    assert Team.log == ["up", "down"]
    with pytest.raises(ValueError, match="payload"):
        Extensions([Team(spark), Team(spark)]).payload()


def test_searches_by_the_index(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(30):
        (src / f"f{k}.md").write_text(f"# Title {k}\n\nText number {k}.\n")
    engine = Engine(spark, Config(project="demo", state_dir=str(tmp_path / "state"), root=str(src), buckets=4))
    engine.reindex()
    text = lambda k: engine.points.read().where(F.col("file_path") == f"f{k}.md").select(F.concat_ws("\n", "header", "source_text").alias("t")).first().t
    top = lambda query, k=1: [(h.chunk_key, round(h.score, 6)) for h in engine.search_code(query, k).collect()]
    queries = [text(3), text(17)]
    before = [top(q) for q in queries]
    index = engine.build_index()
    assert index.points(spark).count() == 30 and [top(q) for q in queries] == before
    (src / "f3.md").write_text("# Other\n\nNothing of the kind.\n")
    (src / "new.md").write_text("# New\n\nA new one.\n")
    (src / "f17.md").unlink()
    engine.reindex()
    new = engine.points.read().where("file_path = 'new.md'").first()
    assert top(new.header + "\n" + new.source_text) == [(new.point_id, 1.0)]
    assert {h[0] for q in queries for h in top(q, 5)}.isdisjoint({b[0][0] for b in before} - {r.point_id for r in engine.points.read().collect()})
    assert engine.build_index().points(spark).count() == 30
