"""A sequence of sweeps leaves what one sweep of the last state leaves; changes as they happen; rebuilds and heals."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.api import Engine
from quarry.config import Config, Root
from quarry.operators import resolution
from quarry.sources import snapshots, tree
from quarry.sources.store import Busy, Table

FILES = {
    "a.py": "class A:\n    def go(self):\n        return 1\n",
    "b.py": "from a import A\n\n\nclass B(A):\n    pass\n",
    "c.py": "from b import B\n\n\nclass C(B):\n    def run(self):\n        return self.go()\n",
    "d.py": "import extra\nfrom a import A\nimport os\n\n\ndef use():\n    extra.work()\n    return A().go()\n",
    "pkg/__init__.py": "VERSION = 1\n\n\ndef top():\n    return VERSION\n",
    "readme.md": "# Title\n\nText.\n",
}


def write(root, files):
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)


def engine_of(spark, root, state, **more):
    return Engine(spark, Config(project="demo", state_dir=str(state), root=str(root), buckets=4, **more))


def refs(engine):
    return sorted((r.src_qname, r.dst, r.kind, r.resolved, r.file_path) for r in engine.refs.read().collect())


def nodes(engine):
    return sorted((r.kind, r.qualified_name, r.file_path, r.chunk_id or "") for r in engine.nodes.read().collect())


CHANGES = [
    ("a remark in c", {"c.py": "# a remark\n" + FILES["c.py"]}, []),
    ("a method moves to a base's base", {"a.py": "class Z:\n    def go(self):\n        return 1\n\n\nclass A(Z):\n    pass\n"}, []),
    ("a nearer method", {"b.py": FILES["b.py"].replace("    pass", "    def go(self):\n        return 2")}, []),
    ("a module comes", {"extra.py": "def work():\n    pass\n"}, []),
    ("a module goes", {}, ["a.py"]),
    ("a new base", {"b.py": "class Other:\n    def go(self):\n        return 3\n\n\nclass B(Other):\n    pass\n"}, []),
]


def test_sweeps_equal_one_sweep(spark, tmp_path):
    root = tmp_path / "src"
    write(root, FILES)
    engine = engine_of(spark, root, tmp_path / "state")
    first = engine.reindex().first()
    assert (first.indexed, first.failed, first.skipped, first.disposition) == (6, 0, 0, "rebuilt")
    assert ("c.C.run", "a.A.go", "calls", True, "c.py") in refs(engine)
    for what, changed, gone in CHANGES:
        time.sleep(0.01)
        write(root, changed)
        for path in gone:
            (root / path).unlink()
        out = engine.reindex().first()
        assert (out.indexed, out.purged, out.failed) == (len(changed), len(gone), 0), what
        raw, own = engine.raw.read(), engine.nodes.read()
        whole = resolution.resolve(raw, own, resolution.bases_of(raw, own))
        assert sorted((r.src_qname, r.dst, r.kind, r.resolved, r.file_path) for r in whole.collect()) == [r for r in refs(engine) if r[2] != "defines"], what
    fresh = engine_of(spark, root, tmp_path / "fresh")
    fresh.reindex()
    assert refs(engine) == refs(fresh) and nodes(engine) == nodes(fresh)
    assert {r.file_path for r in engine.points.read().collect()} >= {"pkg/__init__.py"}


def test_only_what_a_change_can_touch_is_resolved_again(spark, tmp_path):
    write(tmp_path / "src", FILES | {f"free{k}.py": f"def f{k}():\n    return len([])\n" for k in range(5)})
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state")
    engine.reindex()
    old_nodes, old_raw = engine.nodes.read(), engine.raw.read()
    files = spark.createDataFrame([("default", "a.py")], "tier string, file_path string")
    touched = lambda new_nodes, new_raw: {r.file_path for r in resolution.touched(files, old_nodes, new_nodes, old_raw, new_raw).collect()}
    own_nodes, own_raw = old_nodes.where("file_path = 'a.py'"), old_raw.where("file_path = 'a.py'")
    assert touched(own_nodes, own_raw) == set()
    assert touched(own_nodes.where("kind <> 'method'"), own_raw) == {"c.py"}
    assert touched(own_nodes.limit(0), own_raw.limit(0)) == {"b.py", "c.py", "d.py"}


def test_unchanged_files_are_not_read(spark, tmp_path, monkeypatch):
    write(tmp_path / "src", FILES)
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state")
    engine.reindex()
    asked = []
    contents = tree.contents
    monkeypatch.setattr(tree, "contents", lambda files, root: asked.append([r.file_path for r in files.collect()]) or contents(files, root))
    version = engine.store.snapshot().version
    write(tmp_path / "src", {"a.py": FILES["a.py"], "readme.md": "# Other\n\nText.\n"})  # the same content again, another
    out = engine.reindex().first()
    assert sorted(asked[0]) == ["a.py", "readme.md"] and (out.indexed, out.skipped) == (1, 5)
    assert engine.store.snapshot().version == version + 1  # one commit
    asked.clear()
    engine.reindex()
    assert asked == [[]]  # the new time of the file that is the same is known


def test_listing(spark, tmp_path):
    files = {f"d{k}/e{k % 7}/f{k}.txt": "x" * k for k in range(200)} | {"skip/a/b.txt": "", "d1/skip/c.txt": "", "_under.py": "1", "__init__.py": ""}
    write(tmp_path, files)
    (tmp_path / "link").symlink_to(tmp_path / "d1")
    found = tree.listing(spark, str(tmp_path), "t", ("skip",))
    assert {(r.file_path, r.size) for r in found.collect()} == {(p, len(c)) for p, c in files.items() if "skip" not in p}
    text = tree.contents(found.where("file_path in ('d5/e5/f5.txt', '__init__.py')"), str(tmp_path))
    assert {r.content for r in text.collect()} == {"xxxxx", ""}
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    gone = spark.createDataFrame([("t", "bad.txt"), ("t", "none.txt")], "tier string, file_path string")
    got = {r.file_path: (r.content, r.size) for r in tree.contents(gone, str(tmp_path)).collect()}
    assert got == {"bad.txt": ("a\ufffdb", 3), "none.txt": (None, None)}
    (tmp_path.parent / "secret.txt").write_text("secret")
    (tmp_path / "out.txt").symlink_to(tmp_path.parent / "secret.txt")
    assert tree.read_one(str(tmp_path), "out.txt") is None and tree.read_one(str(tmp_path), "d5/e5/f5.txt") == "xxxxx"


def test_package_tops(spark):
    paths = ["src/pkg/__init__.py", "src/pkg/m.py", "src/pkg/sub/n.py", "src/pkg/sub/__init__.py", "top.py", "a/b/c.py", "__init__.py", "repo/repo/__init__.py", "repo/repo/x.py", "repo/setup.py"]
    files = spark.createDataFrame([("t", p) for p in paths], "tier string, file_path string")
    got = {r.file_path: r.package_top for r in tree.with_package_tops(files).collect()}
    assert got == dict(zip(paths, [1, 1, 1, 1, 0, 0, 0, 1, 1, 0], strict=True))


def test_a_failed_sweep_changes_nothing(spark, tmp_path, monkeypatch):
    write(tmp_path / "src", FILES)
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state")
    engine.reindex()
    before = refs(engine), engine.points.count(), engine.store.snapshot().version
    write(tmp_path / "src", {"a.py": "def new():\n    pass\n"})
    monkeypatch.setattr(engine, "_graph", lambda *a: (_ for _ in ()).throw(RuntimeError("between two tables")))
    with pytest.raises(RuntimeError, match="between"):
        engine.reindex()
    assert (refs(engine), engine.points.count(), engine.store.snapshot().version) == before
    monkeypatch.undo()
    assert engine.reindex().first().indexed == 1


def test_one_writer_at_a_time(spark, tmp_path):
    write(tmp_path / "src", FILES)
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state")
    with engine.writing("another"), pytest.raises(Busy):
        engine.reindex()
    assert engine.reindex().first().indexed == 6


def test_rebuild_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    roots = []
    for tier in ("one", "two"):
        write(tmp_path / tier, FILES)
        roots.append(Root(tier=tier, path=str(tmp_path / tier)))
    config = Config(project="demo", state_dir=str(tmp_path / "state"), roots=roots, buckets=4)
    engine = Engine(spark, config)
    engine.reindex()
    hits = engine.search_code("Title", 3).count()
    config = config.model_copy(update={"embedding": config.embedding.model_copy(update={"dim": 16})})
    engine = Engine(spark, config)
    assert engine.index_status().first().rebuild_needed
    with pytest.raises(RuntimeError, match="reindex"):
        engine.search_code("Title")
    sweep = engine.sweep
    monkeypatch.setattr(engine, "sweep", lambda root, **k: sweep(root, **k) if root.tier == "one" else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        engine.reindex()
    status = engine.index_status().first()
    assert (status.rebuild_state, status.rebuild_done, status.rebuild_total) == ("running", 1, 2)
    assert {len(r.vector) for r in engine.points.read().collect()} == {64}  # the old tables until the end
    monkeypatch.undo()
    out = {r.tier: r.disposition for r in engine.reindex().collect()}
    assert out == {"one": "rebuilt before", "two": "rebuilt"}
    assert {len(r.vector) for r in engine.points.read().collect()} == {16} and engine.search_code("Title", 3).count() == hits
    status = engine.index_status().first()
    assert (status.rebuild_state, status.rebuild_needed) == ("done", False)
    assert not any(t.startswith("next_") for t in engine.store.snapshot().tables)


def test_heal_does_the_least(spark, tmp_path, monkeypatch):
    write(tmp_path / "src", FILES)
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state")
    engine.reindex()
    want = refs(engine), nodes(engine)
    everything = engine.nodes.read().select("tier", "file_path")
    for table in (engine.nodes, engine.refs, engine.raw):
        table.delete(everything, ["tier", "file_path"])
    calls = []
    monkeypatch.setattr("quarry.operators.embedding.embed", lambda *a: calls.append(a))
    assert [r.action for r in engine.heal().collect()] == ["rebuild_graph"]
    monkeypatch.undo()
    assert (refs(engine), nodes(engine)) == want and not calls
    assert [r.action for r in engine.heal().collect()] == ["none"]
    engine.points.delete(engine.points.read().where("file_path = 'a.py'"))
    assert [r.action for r in engine.heal().collect()] == ["purge_and_reset"]
    assert engine.points.count() == engine.index_status().first().expected_chunks and (refs(engine), nodes(engine)) == want


def test_static_tiers(spark, tmp_path):
    write(tmp_path / "src", FILES)
    (tmp_path / "src" / "link.md").symlink_to("readme.md")
    engine = lambda v: Engine(spark, Config(project="demo", state_dir=str(tmp_path / "state"), buckets=4, roots=[Root(tier="pip", path=str(tmp_path / "src"), policy="static", version=v)]))
    one = engine("1")
    assert one.reindex().first().indexed == 7 and one.reindex().first().disposition == "skipped"
    contents = one.store.snapshot().read("static_contents").count()
    assert contents == 6  # the link's is its target's
    links = {r.file_path: r.link for r in one.store.snapshot().read("static_files").where("link is not null").collect()}
    assert links == {"link.md": "readme.md"}
    write(tmp_path / "src", {"a.py": "def other():\n    pass\n"})
    two = engine("2")
    out = two.reindex().first()
    assert (out.disposition, out.indexed) == ("swept", 7)
    now = two.store.snapshot()
    assert now.read("static_files").count() == 14 and now.read("static_contents").count() == contents + 1  # versions share rows
    assert one.read_file("pip", "a.py", 1, 1).first().text == "class A:" and two.read_file("pip", "a.py", 1, 1).first().text == "def other():"
    assert {r.file_path: r.content for r in snapshots.files_of(now, "pip", "1").collect()}["a.py"] == FILES["a.py"]
    # a lost snapshot is taken again, and nothing is embedded if the root is what was indexed
    Table(two.store, "static_contents", ["sha"]).delete(now.read("static_contents").limit(3))
    assert two.reindex().first().disposition == "snapshot taken again" and snapshots.has(two.store.snapshot(), "pip", "2")
    with two.work() as work:
        snapshots.drop(two.store, work, "pip", "2")
    assert not snapshots.has(two.store.snapshot(), "pip", "2")
    write(tmp_path / "src", {"a.py": "def third():\n    pass\n"})
    assert two.reindex().first().disposition == "swept"
    (tmp_path / "src").rename(tmp_path / "away")
    assert two.reindex().first().disposition == "skipped" and two.read_file("pip", "a.py", 1, 1).first().text == "def third():"
    with two.work() as work:
        snapshots.drop(two.store, work, "pip", "2")
    assert two.reindex().first().disposition == "skipped without its root" and two.index_status().first().indexed == 7


def test_waiting_for_a_file(spark, tmp_path):
    write(tmp_path / "src", FILES)
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state")
    engine.reindex()
    assert engine.wait_for_fresh("a.py", 0.1) and engine.wait_for_fresh("unknown.py", 0.1)
    engine.mark(spark.createDataFrame([("default", "a.py")], "tier string, file_path string"))
    assert not engine.wait_for_fresh("a.py", 0.3)
    began = time.monotonic()
    hit = engine.search_code("go", 1, {"path": "a.py"}, wait=0.5).first()
    assert hit.stale and "[STALE" in hit.formatted and time.monotonic() - began >= 0.5
    write(tmp_path / "src", {"a.py": FILES["a.py"] + "\n\ndef late():\n    pass\n"})
    writer = threading.Thread(target=engine.reindex)
    writer.start()
    assert not engine.search_code("late", 1, {"file_path": "a.py"}, wait=60).first().stale
    writer.join()


def test_watching(spark, tmp_path):
    write(tmp_path / "src", FILES)
    engine = engine_of(spark, tmp_path / "src", tmp_path / "state", exclude_globs=["*.tmp"])
    engine.reindex()
    follow = lambda: engine.watch(max_events=20).awaitTermination()
    follow()  # the first listing is what is known
    write(tmp_path / "src", {"c.py": "# a remark\n" + FILES["c.py"], "new.py": "from a import A\n", "x.tmp": "no"})
    (tmp_path / "src" / "b.py").unlink()
    follow()
    fresh = engine_of(spark, tmp_path / "src", tmp_path / "fresh", exclude_globs=["*.tmp"])
    fresh.reindex()
    assert refs(engine) == refs(fresh) and nodes(engine) == nodes(fresh)
    assert engine.index_status().first().indexed == fresh.index_status().first().indexed == 6
    out = engine.reindex().first()  # a sweep has nothing left to do
    assert (out.indexed, out.purged) == (0, 0)
    write(tmp_path / "src", {f"many{k}.py": f"def f{k}():\n    pass\n" for k in range(30)})
    follow()  # more than a version holds: one overflow, and a sweep
    assert engine.index_status().first().indexed == 36
    assert engine.ledger.read().where(F.col("state") != "indexed").isEmpty()


def test_paths_of_roots(spark):
    from quarry.streaming import watch

    roots = spark.createDataFrame([(0, "/src/app/lib", "lib"), (1, "/src/app", "app"), (2, "/src/", "all")], "place int, root string, tier string")
    paths = spark.createDataFrame([(p,) for p in ("/src/app/lib/a.py", "/src/app/b/c.py", "/src/apple/d.py", "/other/e.py", "/src/app", None)], "src string")
    got = {r.src: (r.tier, r.file_path) for r in watch.rooted(paths, roots).collect()}
    assert got == {"/src/app/lib/a.py": ("lib", "a.py"), "/src/app/b/c.py": ("app", "b/c.py"), "/src/apple/d.py": ("all", "apple/d.py"), "/other/e.py": (None, None), "/src/app": ("app", None), None: (None, None)}
