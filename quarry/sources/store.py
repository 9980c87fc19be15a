"""Tables that change by deltas, all tables of a store in one commit.

A table's rows are dealt to buckets by a hash of its key (a file, a note), so a change of one file concerns one bucket.
A commit adds folders of rows, and of keys whose older rows are gone; nothing is overwritten. Reading merges: rows
whose key is gone in a later commit are left out by an anti-join, in buckets where there are such keys. Compaction writes a
bucket anew once it has many folders. What belongs to the tables is said by a log: each commit is one entry, with
the folders that it adds and removes in any number of tables, the version that it was made from, and a checksum. An entry
comes into being whole or not at all, and a number is given once (a hard link on a local disk, a rename that fails if
the target exists on others; object stores without such a rename are not supported), so a writer that dies leaves
nothing but folders that no entry names. A commit whose tables another commit has changed since its own version was read
fails; one that touches other tables, or if it says so other buckets, is put on top.

If the newest entries or their folders are damaged, ``recover`` goes back to the newest whole version. ``vacuum`` deletes
what no version of the last while names. Between processes, leases with an expiry decide who may write.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Event, Thread
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Every so many entries one holds the whole state, so that few are read to know it.
WHOLE_EVERY = 16
#: Folders of a bucket from which on compaction writes it anew.
MOST_PARTS = 8
#: Seconds for which versions stay, so that plans made from them can still run.
RETAIN = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has changed what a commit was made from."""


class Busy(RuntimeError):
    """Someone else holds the lease."""


class Files:
    """Small files by Hadoop's file systems; paths as Spark takes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, path: str) -> dict[str, int]:
        """The data files of a folder with their lengths."""
        fs, p = self.at(path)
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return {n: k for n, k in found if not n.startswith(("_", "."))}

    def changed(self, path: str) -> float:
        fs, p = self.at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self.at(path)
        fs.mkdirs(p)

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist yet, whole or not at all; False if it does exist."""
        fs, target = self.at(path)
        fs.mkdirs(target.getParent())
        _, draft = self.at(f"{path}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        if fs.getScheme() != "file":
            if fs.rename(draft, target):
                return True
            fs.delete(draft, False)
            return False
        nio, uris = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Paths
        as_local = lambda p: uris.get(fs.makeQualified(p).toUri())
        try:
            nio.createLink(as_local(target), as_local(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(draft, False)
        return True


class Work:
    """Intermediate tables of one piece of work, below a folder that all machines share; a written table has no lineage."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files, self.root, self.n = spark, Files(spark), f"{root.rstrip('/')}/{uuid.uuid4().hex}", 0

    def save(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        rows.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{self.n}")

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        self.files.delete(self.root)


def signed(body: dict[str, Any]) -> str:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"sum": hashlib.sha256(text.encode()).hexdigest(), "body": text})


def opened(text: str) -> dict[str, Any] | None:
    """What was signed; None if it is not whole."""
    try:
        outer = json.loads(text)
        return json.loads(outer["body"]) if hashlib.sha256(outer["body"].encode()).hexdigest() == outer["sum"] else None
    except (ValueError, KeyError, TypeError):
        return None


class Snapshot:
    """One version of all tables. Version -1 is that of a store without commits."""

    def __init__(self, store: Store, version: int, state: dict[str, Any]) -> None:
        self.store, self.version, self.tables, self.info = store, version, state["tables"], state["info"]

    def exists(self, name: str) -> bool:
        return name in self.tables

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(json.loads(self.tables[name]["schema"]))

    def buckets(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that a few stated keys are in."""
        at = self.store.bucket(self.tables[name]["key"], self.tables[name]["buckets"])
        return [r[0] for r in keys.select(at).distinct().collect()]

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets of it."""
        if name not in self.tables:
            raise FileNotFoundError(f"no table {name} in {self.store.root}")
        table, only = self.tables[name], None if buckets is None else set(buckets)
        parts = [p for p in table["parts"] if only is None or p["bucket"] in only]
        mixed = {p["bucket"] for p in parts if p["kind"] == "gone"}
        schema, key = self.schema(name), table["key"]
        rows_of = lambda ps, s: self.store.spark.read.schema(s).parquet(*(f"{self.store.root}/{p['path']}" for p in ps))
        stamped = StructType([*schema.fields]).add("_seq", "long")
        plain = [p for p in parts if p["kind"] == "rows" and p["bucket"] not in mixed]
        out = [rows_of(plain, schema)] if plain else []
        old = [p for p in parts if p["kind"] == "rows" and p["bucket"] in mixed]
        if old:
            keys = StructType([schema[k] for k in key]).add("_seq", "long")
            gone = rows_of([p for p in parts if p["kind"] == "gone"], keys).groupBy(*key).agg(F.max("_seq").alias("_gone"))
            a, b = rows_of(old, stamped).alias("a"), gone.alias("b")
            same = reduce(lambda x, y: x & y, (F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in key))
            out.append(a.join(b, same & (F.col("a._seq") < F.col("b._gone")), "left_anti").select(*(f"a.`{f.name}`" for f in schema)))
        return reduce(DataFrame.unionByName, out) if out else self.store.spark.createDataFrame([], schema)

    def state(self) -> dict[str, Any]:
        return {"tables": self.tables, "info": self.info}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.spark, self.root, self.n_buckets, self.files = spark, root.rstrip("/"), buckets, Files(spark)
        self._known: dict[int, dict[str, Any]] = {}  # the states of the last versions that were read; entries never change

    @staticmethod
    def bucket(key: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in key)), F.lit(n)).cast("int").alias("_bucket")

    # versions

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.root}/log") if n.isdigit()]

    def _entry(self, version: int) -> dict[str, Any] | None:
        try:
            return opened(self.files.read(f"{self.root}/log/{version:012d}"))
        except Py4JJavaError:
            return None

    def snapshot(self, at: int | None = None) -> Snapshot:
        """The newest whole version, or the newest that is not above ``at``."""
        for version in reversed([v for v in self.versions() if at is None or v <= at]):
            found = self._state(version)
            if found is not None:
                return Snapshot(self, version, found)
        return Snapshot(self, -1, {"tables": {}, "info": {}})

    def _state(self, version: int) -> dict[str, Any] | None:
        """The state after an entry; None if it, or one that it builds on, is damaged."""
        chain, last = [], version
        while True:
            if version in self._known:
                state = self._known[version]
                break
            entry = self._entry(version) if version >= 0 else {"state": {"tables": {}, "info": {}}}
            if entry is None:
                return None
            if "state" in entry:
                state = entry["state"]
                break
            chain.append(entry)
            version = entry["base"]
        for entry in reversed(chain):
            state = self._after(state, entry)
        self._known = {v: s for v, s in self._known.items() if v > last - 4} | {last: state}
        return state

    @staticmethod
    def _after(state: dict[str, Any], entry: dict[str, Any]) -> dict[str, Any]:
        tables = dict(state["tables"])
        for name, change in entry["tables"].items():
            if change is None:
                tables.pop(name, None)
                continue
            removed = set(change["remove"])
            parts = [p for p in tables.get(name, {"parts": []})["parts"] if p["path"] not in removed]
            tables[name] = {k: change[k] for k in ("schema", "key", "buckets")} | {"parts": parts + change["add"]}
        return {"tables": tables, "info": entry["info"]}

    # commits

    def begin(self) -> Transaction:
        return Transaction(self, self.snapshot())

    def commit(self, base: Snapshot, changes: dict[str, dict[str, Any] | None], info: dict[str, Any] | None = None, by_bucket: bool = False) -> Snapshot:
        """The next version: ``changes`` of tables on top of ``base``, if nobody has changed the same since.

        info: what the state says besides its tables; None keeps it. by_bucket: only commits to the same buckets clash.
        """
        while True:
            # the number comes first: who takes it after an entry that isn't in ``now`` finds it taken
            top = max(self.versions(), default=-1)
            now = self.snapshot(top)
            if now.version != base.version:
                self._check(base, now, changes, info is not None, by_bucket)
            entry: dict[str, Any] = {"base": now.version, "time": time.time(), "tables": changes, "info": now.info if info is None else info}
            number = top + 1
            if number % WHOLE_EVERY == 0:
                entry = {"base": now.version, "time": entry["time"], "state": self._after(now.state(), entry)}
            if self.files.create(f"{self.root}/log/{number:012d}", signed(entry)):
                return self.snapshot(number)

    def _check(self, base: Snapshot, now: Snapshot, changes: dict[str, Any], with_info: bool, by_bucket: bool) -> None:
        if with_info and base.info != now.info:
            raise Conflict("another writer has changed the state")
        for name, change in changes.items():
            paths = lambda s: {p["path"]: p["bucket"] for p in s.tables.get(name, {"parts": []})["parts"]}  # noqa: B023, E731
            was, present = paths(base), paths(now)
            moved = {b for path, b in (was | present).items() if (path in was) != (path in present)}
            own = None if change is None or not by_bucket else {p["bucket"] for p in change["add"]} | {was[p] for p in change["remove"]}
            if moved and (own is None or own & moved):
                raise Conflict(f"another writer has changed {name}")

    # care

    def compact(self, name: str, most: int = MOST_PARTS, base: Snapshot | None = None) -> int:
        """Writes buckets of more than ``most`` folders anew; the number of such buckets."""
        base = base or self.snapshot()
        if not base.exists(name):
            return 0
        count: dict[int, int] = {}
        for p in base.tables[name]["parts"]:
            count[p["bucket"]] = count.get(p["bucket"], 0) + 1
        full = sorted(b for b, n in count.items() if n > most)
        if full:
            tx = Transaction(self, base)
            tx.overwrite(name, base.read(name, full), full)
            tx.commit(by_bucket=True)
        return len(full)

    def whole(self, snapshot: Snapshot) -> bool:
        """Whether all files that a version names are there in their length."""
        return all(self.files.sizes(f"{self.root}/{p['path']}") == p["files"] for t in snapshot.tables.values() for p in t["parts"])

    def recover(self) -> int:
        """Makes the newest whole version the current one again, by a commit of its state; that version's number."""
        at = None
        newest = max(self.versions(), default=-1)
        while True:
            found = self.snapshot(at)
            if self.whole(found):
                break
            at = found.version - 1
        if found.version != newest:
            entry = {"base": found.version, "time": time.time(), "state": found.state()}
            if not self.files.create(f"{self.root}/log/{newest + 1:012d}", signed(entry)):
                raise Conflict("another writer was first")
        return found.version

    def vacuum(self, retain: float = RETAIN) -> int:
        """Deletes folders that no version of the last ``retain`` seconds names, those of dead writers among them."""
        old = time.time() - retain
        entries = [(v, e) for v in self.versions() if (e := self._entry(v)) is not None]
        recent = {v for v, e in entries if e["time"] >= old} | {v for v, _ in entries[-1:]}
        before = [v for v, _ in entries if v < min(recent, default=0)]
        recent |= set(before[-1:])  # readers that began before the first of them
        named = {p["path"] for v in recent for t in (self._state(v) or {"tables": {}})["tables"].values() for p in t["parts"]}
        n = 0
        for folder in self.files.names(f"{self.root}/data"):
            if self.files.changed(f"{self.root}/data/{folder}") >= old:
                continue
            paths = [f"data/{folder}/{kind}/{b}" for kind in ("rows", "gone") for b in self.files.names(f"{self.root}/data/{folder}/{kind}") if b.startswith("_bucket=")]
            unused = [p for p in paths if p not in named]
            for path in unused if len(unused) < len(paths) else [f"data/{folder}"]:
                self.files.delete(f"{self.root}/{path}")
                n += 1
        needed, first = min(recent, default=0), 0
        for v, e in entries:
            if v <= needed and "state" in e:
                first = v
        for v in self.versions():
            if v < first:
                self.files.delete(f"{self.root}/log/{v:012d}")
        return n

    def wait(self, done: Callable[[Snapshot], bool], timeout: float, every: float = 0.1) -> Snapshot | None:
        """The first version for which ``done`` holds; None if there is none before the deadline."""
        end, seen = time.monotonic() + timeout, None
        while True:
            now = self.snapshot()
            if now.version != seen and done(now):
                return now
            seen = now.version
            if time.monotonic() >= end:
                return None
            time.sleep(min(every, max(0.0, end - time.monotonic())))


class Transaction:
    """Changes made from one version, committed together."""

    def __init__(self, store: Store, base: Snapshot) -> None:
        self.store, self.base, self.changes = store, base, {}

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table as it was at the beginning; without one, no rows of the schema."""
        if not self.base.exists(name) and schema is not None:
            return self.store.spark.createDataFrame([], schema)
        return self.base.read(name)

    def _change(self, name: str, schema: StructType, key: list[str] | None) -> dict[str, Any]:
        known = self.base.tables.get(name)
        if known is None and not key:
            raise ValueError(f"{name} is new and needs a key")
        if known is not None:
            have, given = self.base.schema(name).simpleString(), schema.simpleString()  # without what can be null
            if have != given:
                raise ValueError(f"{name} has other columns: {have}, not {given}")
        fixed = {k: known[k] for k in ("schema", "key", "buckets")} if known else {"schema": schema.json(), "key": key, "buckets": self.store.n_buckets}
        return self.changes.setdefault(name, fixed | {"add": [], "remove": []})

    def _write(self, change: dict[str, Any], rows: DataFrame, kind: str) -> None:
        folder = f"data/{uuid.uuid4().hex}/{kind}"
        rows = rows.withColumn("_seq", F.lit(self.base.version + 1).cast("long")).withColumn("_bucket", self.store.bucket(change["key"], change["buckets"]))
        # files of a sensible size: small buckets share a task, one of very many rows has several
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.store.root}/{folder}")
        for name in self.store.files.names(f"{self.store.root}/{folder}"):
            if name.startswith("_bucket="):
                path = f"{folder}/{name}"
                change["add"].append({"path": path, "bucket": int(name.removeprefix("_bucket=")), "kind": kind, "files": self.store.files.sizes(f"{self.store.root}/{path}")})

    def put(self, name: str, rows: DataFrame, gone: DataFrame | None = None, key: list[str] | None = None) -> None:
        """Rows come; older rows with one of the keys in ``gone`` go. Nothing else is written."""
        known = self.base.tables.get(name)
        if known is not None:
            rows = rows.select(*self.base.schema(name).names)
        change = self._change(name, rows.schema, key)
        if known is not None and gone is not None:
            keys = StructType([self.base.schema(name)[k] for k in change["key"]])
            self._write(change, gone.select(*(F.col(f.name).cast(f.dataType) for f in keys)).distinct(), "gone")
        self._write(change, rows, "rows")

    def overwrite(self, name: str, rows: DataFrame, buckets: list[int] | None = None, key: list[str] | None = None) -> None:
        """The whole table, or all of some buckets."""
        known = self.base.tables.get(name)
        change = self._change(name, rows.schema, key)
        change["remove"] += [p["path"] for p in (known or {"parts": []})["parts"] if buckets is None or p["bucket"] in buckets]
        self._write(change, rows, "rows")

    def put_all(self, puts: list[tuple[str, DataFrame, DataFrame | None, list[str]]], prefix: str = "") -> None:
        """Several puts at once: (name, rows, gone, key)."""
        with ThreadPoolExecutor(max(1, len(puts))) as pool:
            for done in [pool.submit(self.put, prefix + name, *rest) for name, *rest in puts]:
                done.result()

    def move(self, source: str, target: str) -> None:
        """The table ``source`` takes the place of ``target``; no row is written."""
        table = self.base.tables[source]
        old = self.base.tables.get(target, {"parts": []})["parts"]
        self.changes[target] = {k: table[k] for k in ("schema", "key", "buckets")} | {"add": list(table["parts"]), "remove": [p["path"] for p in old]}
        self.changes[source] = None

    def drop(self, name: str) -> None:
        self.changes[name] = None

    def commit(self, info: dict[str, Any] | None = None, by_bucket: bool = False) -> Snapshot:
        return self.store.commit(self.base, self.changes, info, by_bucket)


class Lease:
    """The right to write, until it expires or is given back. Numbers are given once, so two can't have the same."""

    def __init__(self, store: Store, name: str, seconds: float, owner: str | None = None) -> None:
        self.store, self.seconds, self.owner = store, seconds, owner or uuid.uuid4().hex
        self.folder = f"{store.root}/leases/{name}"

    def _newest(self) -> tuple[int, dict[str, Any]]:
        numbers = [int(n) for n in self.store.files.names(self.folder) if n.isdigit()]
        if not numbers:
            return -1, {"owner": "", "expires": 0}
        found = opened(self.store.files.read(f"{self.folder}/{max(numbers):012d}"))
        return max(numbers), found or {"owner": "", "expires": 0}

    def _next(self, number: int, expires: float) -> None:
        if not self.store.files.create(f"{self.folder}/{number + 1:012d}", signed({"owner": self.owner, "expires": expires})):
            raise Busy("another writer was first")
        for name in self.store.files.names(self.folder):
            if name.isdigit() and int(name) < number:
                self.store.files.delete(f"{self.folder}/{name}")

    def acquire(self) -> Lease:
        """Takes the lease, or makes an own one longer."""
        number, held = self._newest()
        if held["owner"] != self.owner and held["expires"] > time.time():
            raise Busy(f"held by {held['owner']} for {held['expires'] - time.time():.0f} s")
        self._next(number, time.time() + self.seconds)
        return self

    def release(self) -> None:
        number, held = self._newest()
        if held["owner"] == self.owner:
            self._next(number, 0)

    def __enter__(self) -> Lease:
        """Held as long as the block runs: it is made longer again and again."""
        self.acquire()
        self._done = Event()

        def keep() -> None:
            while not self._done.wait(self.seconds / 3):
                self.acquire()

        self._keeper = Thread(target=keep, daemon=True)
        self._keeper.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._done.set()
        self._keeper.join()
        self.release()


class Table:
    """One table of a store, for changes that concern no other. Each change is made from the version it read."""

    def __init__(self, store: Store, name: str, key: list[str]) -> None:
        self.store, self.name, self.key = store, name, key

    def exists(self) -> bool:
        return self.store.snapshot().exists(self.name)

    def read(self) -> DataFrame:
        return self.store.snapshot().read(self.name)

    def count(self, where: Column | None = None) -> int:
        now = self.store.snapshot()
        if not now.exists(self.name):
            return 0
        return (now.read(self.name).where(where) if where is not None else now.read(self.name)).count()

    def replace(self, rows: DataFrame, base: Snapshot) -> Snapshot:
        """The whole table; ``base`` is the version that the rows were made from."""
        tx = Transaction(self.store, base)
        tx.overwrite(self.name, rows, key=self.key)
        return tx.commit()

    def upsert(self, rows: DataFrame) -> Snapshot:
        """Rows come in the place of those with their keys; writers of other buckets don't clash."""
        tx = self.store.begin()
        tx.put(self.name, rows, rows, key=self.key)
        return tx.commit(by_bucket=tx.base.exists(self.name))

    def delete(self, keys: DataFrame, on: list[str] | None = None) -> Snapshot:
        """Rows that agree with one of ``keys`` in the columns ``on``; an empty table of keys deletes nothing."""
        on, tx = on or self.key, self.store.begin()
        rows = tx.read(self.name)
        hit = rows.join(keys.select(*on).distinct(), on, "left_semi").select(*self.key).distinct()
        tx.put(self.name, rows.join(hit, self.key, "left_semi").join(keys.select(*on).distinct(), on, "left_anti"), hit)
        return tx.commit()

    def update(self, where: Column, **values: Column) -> Snapshot:
        """New values where a condition holds; all rows of the keys concerned are written, no others."""
        tx = self.store.begin()
        rows = tx.read(self.name)
        hit = rows.where(where).select(*self.key).distinct()
        new = rows.join(hit, self.key, "left_semi")
        for name, value in values.items():
            new = new.withColumn(name, F.when(where, value).otherwise(F.col(name)))
        tx.put(self.name, new, hit)
        return tx.commit()
