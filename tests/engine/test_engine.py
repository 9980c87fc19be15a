import pytest
from fixtures import FILES

from quarry.api import Engine
from quarry.config import Config


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root, state = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("state")
    for path, content in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    engine = Engine(spark, Config(project="demo", state_dir=str(state), root=str(root), exclude_dirs=["data"], include=["**/*.py", "**/*.md"]))
    engine.reindex()
    engine.dir = root
    return engine


def names(df):
    return sorted(r.qualified_name for r in df.collect())


def test_status_and_skip(engine):
    s = engine.index_status().first()
    assert s.indexed == 6 and s.failed == 0 and s.expected_chunks == engine.points.count() and not s.rebuild_needed
    version = engine.store.snapshot().version
    out = engine.reindex().first()
    assert engine.index_status().first() == s and (out.disposition, out.indexed, out.skipped) == ("swept", 0, 6)
    ids = {r.point_id for r in engine.points.read().collect()}
    assert engine.store.snapshot().version == version and len(ids) == s.expected_chunks


def test_search_ranks_the_same_text_first(engine):
    row = engine.points.read().where("identity = 'Cart.pay'").first()
    hit = engine.search_code(row.header + "\n" + row.source_text, 3).collect()
    assert hit[0].chunk_key == row.point_id and hit[0].score == pytest.approx(1.0) and "[SOURCE:shop/cart.py:26]" in hit[0].formatted
    assert all(h.detail_level == "source" for h in engine.search_code("x", 8, {"path": "shop/cart.py"}, "source").collect())
    with pytest.raises(ValueError):
        engine.search_code("x", 0)


def test_graph(engine):
    assert names(engine.what_imports("shop.errors")) == ["shop.cart"]
    assert names(engine.what_imports("shop.cart.Cart")) == ["tests.test_cart"]
    r = engine.references("shop.cart.total").first()
    assert (r.production_references, r.test_references) == (1, 2)
    assert engine.references("shop.cart.Base.check").first().production_references == 1
    dead = {d.qualified_name: d.reason for d in engine.dead_code().collect()}
    assert dead["shop.cart.orphan"] == "no_references" and dead["shop.cart.Cart"] == "only_referenced_by_tests"
    assert "shop.cart.Base" not in dead and "shop.errors.ShopError" not in dead
    assert {"tests.test_cart", "tests.test_cart.test_total"} == set(names(engine.tests_for("shop/cart.py"))) | set(names(engine.tests_for("shop.cart.total")))
    blast = {b.qualified_name: b.hop for b in engine.blast_radius("shop.errors.EmptyCart").collect()}
    assert blast["shop.cart.Base.check"] == 1 and blast["shop.cart"] == 1 and blast["shop.cart.Cart.pay"] == 2


def test_symbols_and_files(engine):
    s = engine.get_symbol("shop.cart.Cart.pay").first()
    assert (s.file_path, s.line_start) == ("shop/cart.py", 26) and "print_bill" in s.source
    assert engine.get_symbol("EmptyCart").first().chunk_type == "class"
    assert engine.get_symbol("nothing.here").count() == 0
    assert engine.read_file("default", "shop/cart.py", 7, 8).first().text == "def total(prices):\n    return sum(prices)"
    kinds = [engine.read_file(*a).first().error_kind for a in (("no", "x"), ("default", "../x"), ("default", "x.py"), ("default", "shop/cart.py", 900, 901))]
    assert kinds == ["unknown_tier", "outside", "missing", "bad_range"]


def test_memory(engine):
    key = engine.points.read().where("identity = 'orphan'").first().point_id
    a = engine.save_memory("orphan is unused", refs=[(key, 1)])
    assert a == engine.save_memory("orphan is unused", refs=[(key, 1)]) != engine.save_memory("other")
    assert engine.notes.count() == 2
    engine.note_points.delete(engine.notes.read().select("memory_id"))
    hit = engine.recall_memory("orphan is unused", 1).first()
    assert hit.memory_id == a and hit.score == pytest.approx(1.0)
    assert engine.search_code("anything", 100).first().chunk_key == key


def test_changes(engine):
    (engine.dir / "shop/errors.py").unlink()
    (engine.dir / "docs/guide.md").write_text("# New\n\nText.\n")
    engine.reindex()
    s = engine.index_status().first()
    assert s.indexed == 5 and s.expected_chunks == engine.points.count()
    assert [r.identity for r in engine.points.read().where("file_path = 'docs/guide.md'").collect()] == ["New"]
    assert engine.nodes.read().where("file_path = 'shop/errors.py'").count() == 0
    engine.points.delete(engine.points.read().where("identity = 'New'"))
    assert {r.tier: r.action for r in engine.heal().collect()} == {"default": "purge_and_reset"}
    assert engine.index_status().first().expected_chunks == engine.points.count()
