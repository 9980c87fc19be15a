"""Delta tables: merges, conflicts, dead writers, damage, compaction, leases."""

import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.sources.store import MOST_PARTS, WHOLE_EVERY, Busy, Conflict, Lease, Store, Table

SCHEMA = "k int, v string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), 4)


def rows(store, *r):
    return store.spark.createDataFrame(list(r), SCHEMA)


def read(store, name="t"):
    return sorted(map(tuple, store.snapshot().read(name).collect()), key=lambda r: (r[0] is None, r))


def data_files(store):
    return {str(p) for p in Path(store.root).glob("data/*/rows/*/*.parquet")}


def test_changes_of_one_table(store):
    t = Table(store, "t", ["k"])
    assert not t.exists() and t.count() == 0
    t.replace(rows(store, (1, "a"), (2, "b"), (2, "bb")), store.snapshot())
    t.upsert(rows(store, (2, "c"), (3, "d")))
    assert read(store) == [(1, "a"), (2, "c"), (3, "d")]
    t.delete(rows(store, (1, "")))
    t.delete(rows(store))
    t.update(F.col("k") == 3, v=F.lit("z"))
    assert read(store) == [(2, "c"), (3, "z")]
    with pytest.raises(Exception):
        t.upsert(rows(store, (2, "x")).withColumn("v", F.raise_error(F.lit("no"))))
    assert t.count() == 2
    t.replace(rows(store), store.snapshot())
    assert t.exists() and read(store) == []


def test_null_keys_and_other_columns(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, (None, "a"), (1, "b")), store.snapshot())
    t.upsert(rows(store, (None, "c")))
    assert read(store) == [(1, "b"), (None, "c")]
    with pytest.raises(ValueError, match="other columns"):
        t.replace(store.spark.range(1), store.snapshot())


def test_one_change_writes_one_bucket(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, *((k, "x") for k in range(100))), store.snapshot())
    before = data_files(store)
    t.upsert(rows(store, (7, "y"), (7, "z")))
    new = {Path(p).parent.name for p in data_files(store) - before}
    assert before <= data_files(store) and len(new) == 1
    assert read(store) == sorted([*((k, "x") for k in range(100) if k != 7), (7, "y"), (7, "z")])


def test_a_lookup_reads_one_bucket(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, *((k, "x") for k in range(100))), store.snapshot())
    now = store.snapshot()
    buckets = now.buckets("t", rows(store, (7, "")))
    some = now.read("t", buckets)
    assert len(buckets) == 1 and 7 in {r.k for r in some.collect()} and some.count() < 60


def test_lost_updates_are_refused(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, (1, "a")), store.snapshot())
    base = store.snapshot()
    mine = base.read("t").withColumn("v", F.lit("mine"))
    t.upsert(rows(store, (2, "other")))
    with pytest.raises(Conflict):
        t.replace(mine, base)
    assert read(store) == [(1, "a"), (2, "other")]


def test_writers_of_other_tables_and_buckets_do_not_clash(store):
    t, u = Table(store, "t", ["k"]), Table(store, "u", ["k"])
    t.replace(rows(store, *((k, "x") for k in range(20))), store.snapshot())
    a, b, c = store.begin(), store.begin(), store.begin()
    own = {bucket: k for k in range(20) for bucket in store.snapshot().buckets("t", rows(store, (k, "")))}
    one, two = list(own.values())[:2]
    for tx, k in ((a, one), (b, two), (c, one)):
        tx.put("t", rows(store, (k, "new")), rows(store, (k, "")))
    u.replace(rows(store, (1, "u")), store.snapshot())
    a.commit(by_bucket=True)
    b.commit(by_bucket=True)
    with pytest.raises(Conflict):
        c.commit(by_bucket=True)
    assert [r for r in read(store) if r[1] == "new"] == sorted([(one, "new"), (two, "new")]) and read(store, "u") == [(1, "u")]


def test_many_writers_at_once(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store), store.snapshot())
    failed = []

    def write(k):
        while True:
            try:
                t.upsert(rows(store, (k, "w")))
                return
            except Conflict:
                failed.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert read(store) == [(k, "w") for k in range(6)]
    assert store.versions() == list(range(7))


def test_a_writer_that_dies_blocks_nobody(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, (1, "a")), store.snapshot())
    dead = store.begin()
    dead.put("t", rows(store, (1, "dead")), rows(store, (1, "")))  # its folders are there, no entry names them
    (Path(store.root) / "log" / f"{1:012d}.x.draft").write_text("half an en")
    Table(Store(store.spark, store.root, 4), "t", ["k"]).upsert(rows(store, (2, "b")))
    assert read(store) == [(1, "a"), (2, "b")]
    time.sleep(0.05)
    assert store.vacuum(retain=0) >= 1
    assert read(store) == [(1, "a"), (2, "b")]


def test_several_tables_change_together(store):
    for name in ("t", "u"):
        Table(store, name, ["k"]).replace(rows(store, (1, "old")), store.snapshot())
    tx = store.begin()
    tx.put("t", rows(store, (1, "new")), rows(store, (1, "")))
    with pytest.raises(Exception):
        tx.put("u", rows(store, (1, "new")).withColumn("v", F.raise_error(F.lit("no"))), rows(store, (1, "")))
    assert read(store, "t") == read(store, "u") == [(1, "old")]
    tx = store.begin()
    for name in ("t", "u"):
        tx.put(name, rows(store, (1, "new")), rows(store, (1, "")))
    assert read(store, "t") == [(1, "old")]
    tx.commit({"note": 1})
    assert read(store, "t") == read(store, "u") == [(1, "new")] and store.snapshot().info == {"note": 1}


def test_a_table_takes_the_place_of_another(store):
    t, n = Table(store, "t", ["k"]), Table(store, "n", ["k"])
    t.replace(rows(store, (1, "old")), store.snapshot())
    n.replace(rows(store, (2, "new")), store.snapshot())
    tx = store.begin()
    tx.move("n", "t")
    tx.commit()
    assert read(store) == [(2, "new")] and not n.exists()


def test_compaction_keeps_the_rows(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, *((k, "x") for k in range(40))), store.snapshot())
    for n in range(2 * MOST_PARTS):
        t.upsert(rows(store, (n % 3, f"{n}")))
    want, old = read(store), store.snapshot()
    assert store.compact("t") >= 1 and read(store) == want
    parts = store.snapshot().tables["t"]["parts"]
    assert max(sum(p["bucket"] == b for p in parts) for b in range(4)) <= MOST_PARTS
    assert sorted(map(tuple, old.read("t").collect())) == want  # an older version still reads its own folders
    assert store.compact("t") == 0


def test_vacuum_keeps_what_recent_versions_name(store):
    t = Table(store, "t", ["k"])
    for n in range(WHOLE_EVERY + 3):
        t.replace(rows(store, (1, str(n))), store.snapshot())
    assert store.vacuum() == 0 and len(store.versions()) == WHOLE_EVERY + 3
    time.sleep(0.05)
    assert store.vacuum(retain=0) >= WHOLE_EVERY
    assert read(store) == [(1, str(WHOLE_EVERY + 2))]
    assert min(store.versions()) == WHOLE_EVERY
    t.upsert(rows(store, (2, "b")))
    assert len(read(store)) == 2


def test_damage(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, (1, "a")), store.snapshot())
    t.upsert(rows(store, (2, "b")))
    t.upsert(rows(store, (3, "c")))
    log = Path(store.root) / "log"
    torn = log / f"{2:012d}"
    torn.write_text(torn.read_text()[:-9])
    store = Store(store.spark, store.root, 4)
    t = Table(store, "t", ["k"])
    assert read(store) == [(1, "a"), (2, "b")]  # readers see the last whole version
    t.upsert(rows(store, (4, "d")))
    assert read(store) == [(1, "a"), (2, "b"), (4, "d")]
    body = json.loads((log / f"{3:012d}").read_text())
    assert json.loads(body["body"])["base"] == 1
    lost = store.snapshot().tables["t"]["parts"][-1]
    next((Path(store.root) / lost["path"]).glob("*.parquet")).unlink()
    assert not store.whole(store.snapshot())
    assert store.recover() == 1 and read(store) == [(1, "a"), (2, "b")]
    t.upsert(rows(store, (5, "e")))
    assert read(store) == [(1, "a"), (2, "b"), (5, "e")] and store.recover() == store.snapshot().version


def test_leases(store):
    first = Lease(store, "writer", 30, "one").acquire()
    with pytest.raises(Busy, match="one"):
        Lease(store, "writer", 30, "two").acquire()
    first.acquire()  # longer
    first.release()
    with Lease(store, "writer", 0.3, "two"):
        time.sleep(0.8)  # longer than the lease, which is kept
        with pytest.raises(Busy):
            Lease(store, "writer", 30, "three").acquire()
    Lease(store, "writer", 0.2, "dead").acquire()
    with pytest.raises(Busy):
        Lease(store, "writer", 30, "three").acquire()
    time.sleep(0.3)
    Lease(store, "writer", 30, "three").acquire()
    assert len(list(Path(store.root).glob("leases/writer/*"))) <= 3


def test_waiting(store):
    t = Table(store, "t", ["k"])
    t.replace(rows(store, (1, "a")), store.snapshot())
    assert store.wait(lambda s: s.version >= 1, 0.3) is None
    writer = threading.Timer(0.5, lambda: t.upsert(rows(store, (2, "b"))))
    writer.start()
    found = store.wait(lambda s: s.version >= 1, 30)
    assert found is not None and found.read("t").count() == 2
    writer.join()
