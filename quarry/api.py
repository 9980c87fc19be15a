"""The engine: indexing and the twelve operations, over the tables of a store in a state folder.

A sweep commits points, graph and ledger together, so readers see all of it or nothing, and a sweep that fails changes
nothing. A sweep lists files without reading them, reads those whose time or size has changed, and writes the buckets
of the changed files alone; references of other files are resolved again where the change can touch them. When the
configuration of the vectors changes, all is built anew beside the old tables, tier by tier, which a later run can go on
with, and takes their place in one commit.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial, reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import config as cfg
from quarry.chunkers import markup
from quarry.extension import Extensions, Source
from quarry.functions.keys import point_id
from quarry.operators import chunking, embedding, graph, manifest, memory, resolution, search, symbols, vector_index
from quarry.sources import corpus, snapshots, tree
from quarry.sources.store import Lease, Snapshot, Store, Table, Transaction, Work
from quarry.streaming import changes, watch

KEY = ["tier", "file_path"]
LEDGER = "tier string, file_path string, sha string, mtime_ns long, size long, n_chunks int, chunk_ids array<string>, state string, updated_at timestamp"
NODES = "kind string, qualified_name string, file_path string, chunk_id string, tier string"
REFS = "src_qname string, dst string, kind string, resolved boolean, tier string, file_path string"
NOTES = "memory_id string, text string, refs_stamp string, metadata string"
OUTCOMES = "tier string, disposition string, indexed long, failed long, skipped long, purged long, chunks long"
#: The tables that a sweep writes, and where a rebuild writes them until it is done.
SWEPT, NEXT = ["points", "ledger", "nodes", "raw", "refs"], "next_"
#: Seconds for which a writer may hold the store without a sign of life.
LEASE = 600.0


def _metrics(seen: Observation, *names: str) -> dict[str, int]:
    """What was observed; a plan that turned out to have no rows is taken away with what observes it."""
    try:
        return seen.get
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


class Engine:
    def __init__(self, spark: SparkSession, config: cfg.Config, extensions: Extensions | None = None) -> None:
        self.spark, self.config, self.extensions = spark, config, extensions or Extensions()
        self.registry, self.chunkers = chunking.default_registry(), dict(chunking.CHUNKERS)
        self.registry.override(config.chunkers)
        if self.extensions.profiles():
            self.chunkers["xml"] = partial(markup.xml, profiles=self.extensions.profiles())
        self.store = Store(spark, config.state_dir, config.buckets)
        self.points, self.ledger, self.nodes, self.raw, self.refs = (Table(self.store, name, KEY) for name in SWEPT)
        self.notes, self.note_points = (Table(self.store, name, ["memory_id"]) for name in ("notes", "note_points"))

    def _factory(self) -> Callable[[], embedding.Client]:
        """Makes a client, on the driver or in a worker."""
        e = self.config.embedding
        return partial(embedding.client, e.backend, dim=e.dim, max_input_tokens=e.max_input_tokens)

    def _client(self) -> embedding.Client:
        return self._factory()()

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _ledger(self, at: Snapshot | None = None) -> DataFrame:
        at = at or self.store.snapshot()
        return at.read("ledger") if at.exists("ledger") else self._empty(LEDGER)

    def writing(self, owner: str | None = None) -> Lease:
        """The right to sweep; another process that has it makes this one fail, until it gives it back or dies."""
        return Lease(self.store, "writer", LEASE, owner)

    # indexing

    def fingerprint(self) -> str:
        return cfg.fingerprint(self.config, tuple(self.extensions.payload()))

    def source(self, root: cfg.Root) -> Source:
        return self.extensions.source(root.source, Source(tree.listing, tree.contents))

    def tool(self, name: str, *args: Any, **more: Any) -> DataFrame:
        """One of the extensions' tools."""
        return self.extensions.tool(self, name).run(*args, **more)

    def __enter__(self) -> Engine:
        self.extensions.start(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.extensions.stop(self)

    def listing(self, root: cfg.Root) -> DataFrame:
        """(tier, file_path, mtime_ns, size) of the files in scope; nothing is read."""
        files = self.source(root).listing(self.spark, root.path, root.tier, tuple(self.config.exclude_dirs))
        return files.where(corpus.is_included(F.col("file_path"), self.config.include, self.config.exclude_globs))

    def rebuild_needed(self) -> bool:
        return self.store.snapshot().info.get("fingerprint") != self.fingerprint()

    def reindex(self, tier: str | None = None) -> DataFrame:
        """Sweeps the tiers' files; returns what became of them, a row for each tier.

        New and changed files are chunked and embedded, vanished ones purged. A static tier whose version is there is
        skipped. If the configuration of the vectors has changed, everything is rebuilt (of all tiers only).
        """
        roots = [r for r in self.config.effective_roots() if tier in (None, r.tier)]
        if not roots:
            raise ValueError(f"unknown tier {tier}")
        with self.writing():
            if self.rebuild_needed() and tier is None:
                out = self._rebuild(roots)
            else:
                out = [self._sweep_or_skip(root) for root in roots]
        return self.spark.createDataFrame(out, OUTCOMES)

    def _sweep_or_skip(self, root: cfg.Root) -> tuple:
        """A static tier whose version is indexed is not swept again.

        Its snapshot is taken with the first sweep. If it is lost it is taken again from the root; if the root still holds
        what was indexed, nothing more is done, else it is swept. A root that is gone leaves the index as it is.
        """
        now = self.store.snapshot()
        if root.policy != "static":
            return self.sweep(root)
        version, built = root.version or "", now.info.get("versions", {}).get(root.tier)
        if built == version and self._has_files(now, root.tier):
            if snapshots.has(now, root.tier, version):
                return (root.tier, "skipped", 0, 0, 0, 0, 0)
            self._take(root)
            now = self.store.snapshot()
            if not now.exists("static_files"):
                return (root.tier, "skipped without its root", 0, 0, 0, 0, 0)
            found = now.read("static_files").where((F.col("tier") == root.tier) & (F.col("version") == version)).select("file_path", "sha")
            indexed = self._ledger(now).where(F.col("tier") == root.tier).select("file_path", "sha")
            if found.isEmpty():
                return (root.tier, "skipped without its root", 0, 0, 0, 0, 0)
            if resolution.symmetric(found, indexed).isEmpty():
                return (root.tier, "snapshot taken again", 0, 0, 0, 0, 0)
        else:
            self._take(root)
        return self.sweep(root, everything=True)

    def _take(self, root: cfg.Root) -> None:
        """The snapshot of a static root's files."""
        if root.source is None:
            with self.work() as work:
                snapshots.take(self.store, work, self.listing(root), root.path, root.tier, root.version or "")

    def _has_files(self, now: Snapshot, tier: str) -> bool:
        return not self._ledger(now).where((F.col("tier") == tier) & (F.col("state") == "indexed")).isEmpty()

    def _rebuild(self, roots: list[cfg.Root]) -> list[tuple]:
        """All tiers into tables of their own, which then take the place of the old ones.

        The state says which tiers are done, so a rebuild that was cut off goes on where it stopped, if the configuration
        is the same.
        """
        wanted = self.fingerprint()
        status = self.store.snapshot().info.get("rebuild", {})
        if status.get("state") != "running" or status.get("fingerprint") != wanted:
            tx = self.store.begin()
            for name in SWEPT:
                if tx.base.exists(NEXT + name):
                    tx.drop(NEXT + name)
            tx.commit(tx.base.info | {"rebuild": {"state": "running", "fingerprint": wanted, "done": [], "total": len(roots)}})
        out = []
        for root in roots:
            status = self.store.snapshot().info["rebuild"]
            if root.tier in status["done"]:
                out.append((root.tier, "rebuilt before", 0, 0, 0, 0, 0))
                continue
            if root.policy == "static":
                self._take(root)
            info = {"rebuild": status | {"done": [*status["done"], root.tier]}}
            out.append(self.sweep(root, everything=True, prefix=NEXT, info=info, disposition="rebuilt"))
        tx = self.store.begin()
        for name in SWEPT:
            if tx.base.exists(NEXT + name):
                tx.move(NEXT + name, name)
        tx.base.info.pop("index", None)  # it is of the old points
        rebuild = tx.base.info["rebuild"] | {"state": "done"}
        tx.commit(tx.base.info | {"fingerprint": wanted, "dim": self.config.embedding.dim, "rebuild": rebuild})
        return out

    def work(self) -> Work:
        return Work(self.spark, f"{self.config.state_dir}/work")

    def sweep(self, root: cfg.Root, everything: bool = False, prefix: str = "", info: dict[str, Any] | None = None, disposition: str = "swept") -> tuple:
        """One tier's files; (tier, disposition, indexed, failed, skipped, purged, chunks)."""
        tx = self.store.begin()
        with self.work() as work:
            own = work.save(tx.read(prefix + "ledger", LEDGER).where(F.col("tier") == root.tier))
            files = work.save(manifest.needs_reindex(self.listing(root), own))
            todo = (files if everything else files.where("action <> 'unchanged'")).drop("action")
            todo = work.save(self.source(root).contents(todo, root.path).where("content is not null").withColumn("sha", F.sha2("content", 512)))
            same = None if everything else work.save(manifest.skipped_by_hash(todo, own).drop("content"))
            gone = work.save(manifest.vanished(files, own).select(*KEY))
            found = {**tx.base.info, **(info or {})}
            if root.policy == "static":
                found["versions"] = {**found.get("versions", {}), root.tier: root.version}
            changed = todo if same is None else todo.join(same.select(*KEY), KEY, "left_anti")
            counts = self._apply(tx, work, changed, gone, prefix, same)
            # what is neither to do nor gone was skipped
            counts["skipped"] = files.count() - counts["indexed"] - counts["failed"]
            if tx.changes or found != tx.base.info:
                tx.commit(found if found != tx.base.info else None)
        self._compact(prefix)
        return (root.tier, disposition, *(counts[k] for k in ("indexed", "failed", "skipped", "purged", "chunks")))

    def _compact(self, prefix: str = "") -> None:
        now = self.store.snapshot()
        for name in SWEPT:
            if self.store.compact(prefix + name, base=now):
                now = self.store.snapshot()

    def apply(self, todo: DataFrame, gone: DataFrame) -> dict[str, int]:
        """Indexes the files of ``todo`` (tier, file_path, mtime_ns, size, content, sha) and purges ``gone`` in one commit."""
        tx = self.store.begin()
        with self.work() as work:
            counts = self._apply(tx, work, work.save(todo), work.save(gone.select(*KEY)))
            tx.commit()
        self._compact()
        return counts

    def _points_of(self, chunks: DataFrame) -> DataFrame:
        """Chunks with their key and the extensions' columns."""
        key = point_id(self.config.project, F.col("tier"), F.col("file_path"), F.col("chunk_type"), F.col("identity"), F.col("sub_ordinal"))
        return chunks.where("error is null").withColumn("point_id", key).withColumns(self.extensions.payload())

    def _chunks_of(self, files: DataFrame) -> DataFrame:
        return chunking.chunk_files(files, self.registry, self.chunkers, self.config.project, self.config.embedding.max_input_tokens)

    def _apply(self, tx: Transaction, work: Work, todo: DataFrame, gone: DataFrame, prefix: str = "", same: DataFrame | None = None) -> dict[str, int]:
        """Puts the changes of files into a transaction: those to do, those that are gone, and those whose content is the same."""
        old = tx.read(prefix + "ledger", LEDGER)
        if todo.isEmpty() and gone.isEmpty():
            counts = {"chunks": 0, "indexed": 0, "failed": 0, "purged": 0}
            rows = self._touched(old, same)
            if rows is not None and not rows.isEmpty():
                tx.put(prefix + "ledger", rows, rows.select(*KEY), KEY)
            return counts
        chunks = work.save(self._chunks_of(todo))
        good = self._points_of(chunks).withColumn("embedding_text", chunking.embedding_text(F.col("header"), F.col("source_text")))
        points = work.save(embedding.embed(good, "embedding_text", self._factory()))
        bad = work.save(points.where("vector is null").select(*KEY).unionByName(chunks.where("error is not null").select(*KEY)).distinct())
        ids = points.groupBy(*KEY).agg(F.collect_list("point_id").alias("chunk_ids"))
        outcomes = todo.drop("content").join(bad.withColumn("bad", F.lit(True)), KEY, "left").join(ids, KEY, "left")
        outcomes = work.save(outcomes.select(*KEY, "sha", "mtime_ns", "size", F.col("bad").isNull().alias("ok"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")))
        replaced = work.save(outcomes.where("ok").select(*KEY).unionByName(gone))
        new = points.join(bad, KEY, "left_anti").drop("error", "embedding_text")
        # counted as the rows are written
        seen, results = Observation(), Observation()
        count = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, 1)), F.lit(0)).cast("long").alias(state)
        rows = manifest.outcome_rows(old, outcomes).withColumn("updated_at", F.current_timestamp())
        rows = rows.observe(results, count("indexed"), count("failed"))
        touched = self._touched(old, same)
        rows = work.save(rows if touched is None else rows.unionByName(touched.select(*rows.columns)))
        python = work.save(new.where(F.col("file_path").endswith(".py")))
        tx.put_all([
            ("points", new.observe(seen, F.count("*").alias("chunks")), replaced, KEY),
            ("ledger", rows, rows.select(*KEY).unionByName(gone), KEY),
            *self._graph(tx, work, python, todo.join(bad, KEY, "left_anti"), replaced),
        ], prefix)
        return {**_metrics(seen, "chunks"), **_metrics(results, "indexed", "failed"), "purged": gone.count()}

    @staticmethod
    def _touched(ledger: DataFrame, same: DataFrame | None) -> DataFrame | None:
        """Ledger rows of files whose content is the same as before: only their time and size are new."""
        if same is None:
            return None
        known = ledger.select(*KEY, "n_chunks", "chunk_ids", F.col("state").alias("_state"))
        rows = same.join(known, KEY).withColumn("updated_at", F.current_timestamp()).withColumn("state", F.col("_state"))
        return rows.select(*ledger.columns)

    def _graph(self, tx: Transaction, work: Work, chunks: DataFrame, files: DataFrame, replaced: DataFrame, prefix: str = "") -> list[tuple]:
        """Nodes, raw references and resolved ones of the files, and of other files that their names concern, to be put."""
        nodes, raw = work.save(graph.derive_nodes(chunks)), work.save(chunking.raw_references(files))
        refs, again = graph.defines(chunks), replaced
        if tx.base.exists(prefix + "raw"):
            old_nodes, old_raw = work.save(tx.read(prefix + "nodes")), work.save(tx.read(prefix + "raw"))
            others, found = resolution.maintained(replaced, old_nodes, nodes, old_raw, raw, work.save)
            defined = tx.read(prefix + "refs").where("kind = 'defines'").join(others, KEY, "left_semi")
            refs, again = refs.unionByName(defined.select(*resolution.REF)), replaced.unionByName(others)
        else:
            found = resolution.resolve(raw, nodes, resolution.bases_of(raw, nodes), work.save)
        return [("refs", refs.unionByName(found), again, KEY), ("nodes", nodes, replaced, KEY), ("raw", raw, replaced, KEY)]

    def rebuild_graph(self, tier: str) -> int:
        """The graph of a tier from its indexed Python files, without a vector; the number of such files."""
        roots = {r.tier: r for r in self.config.effective_roots()}
        tx = self.store.begin()
        with self.work() as work:
            files = self._ledger(tx.base).where((F.col("tier") == tier) & (F.col("state") == "indexed") & F.col("file_path").endswith(".py"))
            files = work.save(self.source(roots[tier]).contents(files.select(*KEY), roots[tier].path).where("content is not null"))
            chunks = work.save(self._points_of(self._chunks_of(files)))
            tx.put_all(self._graph(tx, work, chunks, files, files.select(*KEY)))
            tx.commit()
            return files.count()

    def heal(self) -> DataFrame:
        """The least work for each live tier whose points or graph don't match the ledger; returns what was found.

        A tier with other points than expected is purged and indexed again; one that has lost its graph alone gets it from
        its files.
        """
        live = [r.tier for r in self.config.effective_roots() if r.policy == "live"]
        with self.writing():
            now = self.store.snapshot()
            of = lambda name, schema: now.read(name).where(F.col("tier").isin(live)) if now.exists(name) else self._empty(schema)
            found = manifest.divergence(of("ledger", LEDGER), of("points", "tier string"), of("nodes", NODES)).collect()  # a row for each tier
            for row in found:
                if row["action"] == "rebuild_graph":
                    self.rebuild_graph(row["tier"])
                elif row["action"] == "purge_and_reset":
                    root = next(r for r in self.config.effective_roots() if r.tier == row["tier"])
                    self._purge(row["tier"])
                    self.sweep(root, everything=True)
        return self.spark.createDataFrame(found) if found else self._empty("tier string, expected long, live long, action string")

    def _purge(self, tier: str) -> None:
        """The points of a tier go and its files are to be indexed again."""
        tx = self.store.begin()
        points = tx.read("points")
        tx.put("points", points.limit(0), points.where(F.col("tier") == tier).select(*KEY).distinct())
        own = self._ledger(tx.base).where(F.col("tier") == tier)
        tx.put("ledger", manifest.reset(own, [tier]), own.select(*KEY))
        tx.commit()

    def mark(self, files: DataFrame) -> Snapshot:
        """Files (tier, file_path) of which a change is known: what is found in them is stale until they are indexed."""
        tx = self.store.begin()
        old = self._ledger(tx.base)
        rows = old.join(files.select(*KEY).distinct(), KEY, "left_semi").withColumn("state", F.lit("dirty")).withColumn("updated_at", F.current_timestamp())
        tx.put("ledger", rows, rows.select(*KEY), KEY)
        return tx.commit()

    def wait_for_fresh(self, path: str, timeout: float) -> bool:
        """Waits until all files of this path, in any tier, are indexed, for ``timeout`` seconds at most; whether they are.

        Only the buckets that the path can be in are read, and only after a commit.
        """
        keys = self.spark.createDataFrame([(r.tier, path) for r in self.config.effective_roots()] or [("", path)], "tier string, file_path string")

        def settled(now: Snapshot) -> bool:
            if not now.exists("ledger"):
                return True
            rows = now.read("ledger", now.buckets("ledger", keys))
            return rows.where((F.col("file_path") == path) & (F.col("state") != "indexed")).isEmpty()

        return self.store.wait(settled, timeout) is not None

    # changes as they happen

    def watch(self, every: str | None = None, sweep_every: float = 600.0, max_events: int = 10_000) -> StreamingQuery:
        """Follows the live roots' files: changes are applied in serial micro-batches, sweeps among them.

        every: how often files are listed; None does it once, and ends. A tier of which more than ``max_events`` files have
        changed at once is swept, and all live tiers are every ``sweep_every`` seconds.
        """
        live = [r for r in self.config.effective_roots() if r.policy == "live" and r.source is None]
        roots = self.spark.createDataFrame([(k, tree.opened(r.path)[1], r.tier) for k, r in enumerate(live)], "place int, root string, tier string")
        events = watch.stream(self.spark, [tree.opened(r.path)[1] for r in live], f"{self.config.state_dir}/watch", self.config.exclude_dirs, max_events)
        swept = {"at": time.monotonic()}

        def batch(rows: DataFrame, _: int) -> None:
            rows = watch.rooted(rows, roots).persist()
            with self.writing("watcher"):
                late = time.monotonic() - swept["at"] >= sweep_every
                lost = {r.tier for r in live} if late else {r["tier"] for r in rows.where("event = 'overflow'").select("tier").distinct().collect()}
                for root in live:
                    if root.tier in lost:
                        self.sweep(root)
                swept["at"] = time.monotonic() if late else swept["at"]
                ops = rows.where(~F.col("tier").isin(list(lost)) & F.col("file_path").isNotNull() & (F.col("event") != "overflow"))
                self.apply_operations(changes.operations(ops.withColumn("src", F.col("file_path"))))
            rows.unpersist()

        return changes.run(events, batch, f"{self.config.state_dir}/watch/checkpoint", quiet=None, every=every)

    def apply_operations(self, ops: DataFrame) -> dict[str, int]:
        """The last operation (tier, file_path, op, ts, seq) of each file in scope: indexed from what it holds now, or purged."""
        scope = corpus.is_included(F.col("file_path"), self.config.include, self.config.exclude_globs) & ~corpus.in_excluded_directory(F.col("file_path"), tuple(self.config.exclude_dirs))
        with self.work() as work:
            last = work.save(changes.final_operations(ops.where(scope)))
            if last.isEmpty():
                return {}
            self.mark(last)
            todo = last.where("op = 'index'")
            read = [self.source(r).contents(todo.where(F.col("tier") == r.tier).select(*KEY), r.path) for r in self.config.effective_roots()]
            read = work.save(reduce(DataFrame.unionByName, read))
            found = read.where("content is not null").withColumn("sha", F.sha2("content", 512))
            # a file that went between the event and now is purged
            gone = last.where("op = 'purge'").select(*KEY).unionByName(read.where("content is null").select(*KEY))
            return self.apply(found, gone)

    # the twelve operations

    def _checked_dim(self, now: Snapshot) -> None:
        """Vectors of another length can't be compared: the index has to be rebuilt first."""
        dim = now.info.get("dim")
        if dim is not None and dim != self.config.embedding.dim:
            raise RuntimeError(f"the index has vectors of {dim} components, the configuration of {self.config.embedding.dim}: reindex first")

    def search_code(self, query: str, k: int = 8, filters: dict[str, Any] | None = None, detail_level: str = "auto", wait: float = 0.0) -> DataFrame:
        """The k nearest chunks. wait: seconds that a search in one file waits for its changes at most; then it is stale."""
        if not 1 <= k <= 100:
            raise ValueError("k is from 1 to 100")
        path = (filters or {}).get("file_path", (filters or {}).get("path"))
        if wait and path is not None:
            self.wait_for_fresh(str(path), wait)
        now = self.store.snapshot()
        self._checked_dim(now)
        vector = self._client().embed_query(query)
        hits = self.extensions.augmented(self._nearest(now, vector, k, filters), query)
        # the order that the extensions leave is kept; k rows, so one task numbers them
        hits = hits.withColumn("place", F.monotonically_increasing_id()).withColumn("chunk_key", self.extensions.chunk_key(F.col("point_id")))
        recalled = self.recall_memory(query, 5)
        refs = recalled.select(F.explode("refs").alias("r")).select(F.col("r.chunk_key").alias("chunk_key"))
        hits = search.boosted(hits, refs, "chunk_key").withColumn("noted", F.col("score") >= search.BOOST)
        hits = manifest.flag_stale(hits, self._ledger(now)).withColumn("detail", self.extensions.detail(search.detail(F.col("chunk_type"))))
        text = search.citation(F.col("file_path"), F.col("line_start"), F.col("chunk_key"), F.col("source_text"), F.col("stale"))
        out = hits if detail_level == "auto" else hits.where(F.col("detail") == detail_level)
        # what a note refers to comes first, by score; the others stay in the order that they had
        out = out.orderBy(F.desc("noted"), F.when(F.col("noted"), -F.col("score")), "place", "chunk_key")
        return out.select("chunk_key", F.col("detail").alias("detail_level"), "stale", "score", self.extensions.format(text).alias("formatted"))

    def build_index(self) -> vector_index.Index:
        """An inverted file of the points of now; later searches read its nearest cells, and what has changed since whole."""
        with self.writing():
            now = self.store.snapshot()
            parts = {p["path"]: p["bucket"] for p in now.tables["points"]["parts"]}
            points = now.read("points").withColumn("_bucket", self.store.bucket(KEY, now.tables["points"]["buckets"]))
            index = vector_index.build(points, f"{self.config.state_dir}/index", self.config.embedding.dim)
            tx = self.store.begin()
            tx.commit(tx.base.info | {"index": {"path": index.path, "parts": parts}})
        return index

    def _nearest(self, now: Snapshot, vector: list[float], k: int, filters: dict[str, Any] | None) -> DataFrame:
        """By the index, but for buckets that have changed since it was built: these are read whole."""
        known = now.info.get("index")
        points = now.read("points")
        if known is None:
            return search.top_k(points, vector, k, filters)
        parts = {p["path"]: p["bucket"] for p in now.tables["points"]["parts"]}
        changed = sorted({b for path, b in (parts | known["parts"]).items() if (path in parts) != (path in known["parts"])})
        index = vector_index.opened(self.spark, known["path"])
        hits = vector_index.search(self.spark, index, vector, k, search.matches(filters) & ~F.col("_bucket").isin(changed))
        hits = hits.select(*points.columns, "score")
        if changed:
            hits = hits.unionByName(search.top_k(now.read("points", changed), vector, k, filters)).orderBy(F.desc_nulls_last("score"), "point_id").limit(k)
        return hits

    def _content(self, root: cfg.Root, path: str) -> str | None:
        """A static tier's file from its snapshot, which stays when the root has gone or changed."""
        if root.policy == "static":
            found = snapshots.one(self.store.snapshot(), root.tier, root.version or "", path)
            if found is not None:
                return found
        if root.source is None:
            return tree.read_one(root.path, path)
        wanted = self.spark.createDataFrame([(root.tier, path)], "tier string, file_path string")
        return self.source(root).contents(wanted, root.path).first()["content"]

    def read_file(self, tier: str, path: str, line_start: int | None = None, line_end: int | None = None) -> DataFrame:
        """A span of one file; no other file is read or listed."""
        wanted = self.spark.createDataFrame([(tier, path, line_start, line_end)], "tier string, path string, line_start int, line_end int")
        roots = {r.tier: r for r in self.config.effective_roots()}
        safe = path and not path.startswith("/") and ".." not in path.split("/")
        content = self._content(roots[tier], path) if tier in roots and safe else None
        found = [(tier, path, content)] if content is not None else []
        return symbols.read_spans(wanted, self.spark.createDataFrame(found, "tier string, file_path string, content string"), list(roots))

    def get_symbol(self, qualified_name: str) -> DataFrame:
        return symbols.get_symbol(self.points.read(), qualified_name)

    def what_imports(self, target: str) -> DataFrame:
        return graph.what_imports(self.nodes.read(), self.refs.read(), target)

    def blast_radius(self, target: str, depth: int = 3, max_results: int = 50) -> DataFrame:
        return graph.blast_radius(self.nodes.read(), self.refs.read(), target, depth, max_results)

    def tests_for(self, symbol_or_file: str) -> DataFrame:
        return graph.tests_for(self.nodes.read(), self.refs.read(), symbol_or_file)

    def references(self, name: str) -> DataFrame:
        return graph.references(self.nodes.read(), self.refs.read(), name)

    def dead_code(self, include_tests: bool = False, include_dunders: bool = False, include_entrypoints: bool = False, max_results: int = 100) -> DataFrame:
        live = [r.tier for r in self.config.effective_roots() if r.policy == "live"]
        return graph.dead_code(self.nodes.read(), self.refs.read(), live, max_results, include_tests, include_dunders, include_entrypoints)

    def save_memory(self, text: str, metadata: str = "{}", refs: list[tuple[str, int]] | None = None) -> str:
        """Into the ledger and embedded, in one commit; the same text and references are one note."""
        note = self.spark.createDataFrame([(text, metadata, [(k, v) for k, v in refs or []], 0)], "text string, metadata string, refs array<struct<chunk_key:string,key_version:int>>, seq int")
        row = memory.saved(note).persist()
        tx = self.store.begin()
        tx.put("notes", row, row, ["memory_id"])
        points = self._note_points(row)
        tx.put("note_points", points, points, ["memory_id"])
        # notes of other buckets can be saved meanwhile
        tx.commit(by_bucket=tx.base.exists("notes") and tx.base.exists("note_points"))
        for name in ("notes", "note_points"):
            self.store.compact(name)
        return row.first()["memory_id"]

    def _note_points(self, ledger: DataFrame) -> DataFrame:
        """By the configured client, as queries are. A note whose embedding fails stays in the ledger for the next time."""
        points = embedding.embed(memory.as_points(ledger), "note_text", self._factory())
        return points.where("vector is not null")

    def restore_memory(self) -> int:
        """Notes whose points are lost are embedded again, points that the ledger doesn't know become notes; how many of both."""
        tx = self.store.begin()
        if not tx.base.exists("notes"):
            return 0
        with self.work() as work:
            notes, points = tx.read("notes"), tx.read("note_points")
            lost = work.save(self._note_points(memory.missing(notes, points)))
            unknown = work.save(memory.backfilled(notes, points).join(notes.select("memory_id"), "memory_id", "left_anti"))
            n = lost.count() + unknown.count()
            if n:
                tx.put_all([("note_points", lost, lost, ["memory_id"]), ("notes", unknown, unknown, ["memory_id"])])
                tx.commit()
        return n

    def recall_memory(self, query: str, k: int = 5) -> DataFrame:
        if not 1 <= k <= 100:
            raise ValueError("k is from 1 to 100")
        if not self.notes.exists():
            return self._empty("memory_id string, note_text string, refs array<struct<chunk_key:string,key_version:int>>, score double")
        if not memory.missing(self.notes.read(), self.note_points.read()).isEmpty():
            self.restore_memory()
        hits = search.top_k(self.note_points.read(), self._client().embed_query(query), k, key="memory_id")
        return hits.select("memory_id", "note_text", "refs", "score")

    def index_status(self) -> DataFrame:
        """One row: files by state, and whether a rebuild is needed or how far it is."""
        now = self.store.snapshot()
        rebuild = now.info.get("rebuild", {})
        more = {"fingerprint": now.info.get("fingerprint"), "rebuild_state": rebuild.get("state", "none"), "rebuild_done": len(rebuild.get("done", [])), "rebuild_total": rebuild.get("total", 0)}
        out = reduce(lambda df, x: df.withColumn(x[0], F.lit(x[1])), more.items(), manifest.status(self._ledger(now)))
        return out.withColumn("rebuild_needed", F.lit(self.rebuild_needed()))
