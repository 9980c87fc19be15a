"""Queries over tables that change: references kept right by deltas, merged tables, the vector index, roots and heals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.text import lines
from quarry.operators import graph, manifest, memory, resolution, vector_index
from quarry.plans import tables as t
from quarry.plans.catalogue import COS, NOTES, OUT, SQL, W_, batch, register, snapshots
from quarry.sources import tree
from quarry.sources.store import Store, Table, Work
from quarry.streaming import watch


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share: below ``spark.checkpoint.dir``, which only a session on one machine may lack."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(shared or '/tmp/quarry-checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


# a project of one module a supplier, in two versions: some modules come, some go, some change


def name(*parts: object) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))  # type: ignore[attr-defined]


def modules(spark: SparkSession, d: str, version: int) -> DataFrame:
    """(s, tier, file_path, base, shift): the suppliers' modules; shift is 1 in those that have changed."""
    s = F.col("s_suppkey")
    shift = F.when(s % 7 == 0, version - 1).otherwise(0)
    rows = t.read(spark, d, "supplier").where(s % F.lit({1: 13, 2: 11}[version]) != 0)
    base = F.floor(s / F.when(shift == 1, 2).otherwise(3))
    return rows.select(s.alias("s"), F.lit("live").alias("tier"), name("m", s, ".py").alias("file_path"), base.alias("base"), shift.alias("shift"))


def project_nodes(spark: SparkSession, d: str, version: int) -> DataFrame:
    rows, s = modules(spark, d, version), F.col("s")
    node = lambda kind, qname: F.struct(F.lit(kind).alias("kind"), qname.alias("qualified_name"))
    own = F.array(node("module", name("m", s)), node("class", name("m", s, ".K")))
    methods = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda j: (s * 7 + j + F.col("shift")) % 3 == 0)
    every = F.concat(own, F.transform(methods, lambda j: node("method", name("m", s, ".K.f", j))))
    return rows.select(F.explode(every).alias("n"), "file_path", "tier").select("n.kind", "n.qualified_name", "file_path", F.lit(None).cast("string").alias("chunk_id"), "tier")


def project_raw(spark: SparkSession, d: str, version: int) -> DataFrame:
    rows, s, base = modules(spark, d, version), F.col("s"), F.col("base")
    ref = lambda src, kind, how, target: F.struct(src.alias("src_qname"), F.lit(kind).alias("kind"), F.lit(how).alias("how"), target.alias("target"))
    written = F.when(base > 0, F.array(ref(name("m", s, ".K"), "inherits", "name", name("m", base, ".K")), ref(name("m", s), "imports", "symbol", name("m", base, ".K"))))
    written = F.concat(F.coalesce(written, F.array()), F.array(ref(name("m", s), "imports", "symbol", F.lit("ext.tool")), ref(name("m", s), "imports", "module", F.lit("m1"))))
    own = rows.select("tier", "file_path", F.explode(written).alias("r")).select("tier", "file_path", "r.*")
    called = t.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % (F.col("l_suppkey") + 1)).alias("x"), (F.col("l_linenumber") % 6).alias("j")).distinct()
    calls = called.join(rows, "s").select("tier", "file_path", name("m", s, ".K").alias("src_qname"), F.lit("calls").alias("kind"), F.lit("method").alias("how"), name("m", F.col("x"), ".K.f", (F.col("j") + F.col("shift")) % 6).alias("target"))
    return own.unionByName(calls)


PROJECT_SQL = """WITH RECURSIVE mods AS (SELECT s_suppkey AS s, 'm' || s_suppkey || '.py' AS file_path, (s_suppkey % 7 = 0)::int AS shift, s_suppkey // CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 3 END AS base
    FROM supplier WHERE s_suppkey % 11 <> 0),
  methods AS (SELECT 'm' || s || '.K' AS cls, 'f' || j AS member, 'm' || s || '.K.f' || j AS full_name FROM mods, range(5) r(j) WHERE (s * 7 + j + shift) % 3 = 0),
  names AS (SELECT 'm' || s AS q FROM mods UNION SELECT 'm' || s || '.K' FROM mods UNION SELECT full_name FROM methods),
  raw AS (SELECT file_path, 'm' || s || '.K' AS src, 'inherits' AS kind, 'name' AS how, 'm' || base || '.K' AS target FROM mods WHERE base > 0
    UNION ALL SELECT file_path, 'm' || s, 'imports', 'symbol', 'm' || base || '.K' FROM mods WHERE base > 0
    UNION ALL SELECT file_path, 'm' || s, 'imports', 'symbol', 'ext.tool' FROM mods UNION ALL SELECT file_path, 'm' || s, 'imports', 'module', 'm1' FROM mods
    UNION ALL SELECT file_path, 'm' || s || '.K', 'calls', 'method', 'm' || x || '.K.f' || (j + shift) % 6
      FROM (SELECT DISTINCT l_suppkey AS s, l_partkey % (l_suppkey + 1) AS x, l_linenumber % 6 AS j FROM lineitem) JOIN mods USING (s)),
  edges AS (SELECT src AS cls, target AS base FROM raw WHERE kind = 'inherits' AND target IN (SELECT q FROM names)),
  up AS (SELECT cls, base, 1 AS k FROM edges UNION ALL SELECT up.cls, e.base, k + 1 FROM up JOIN edges e ON up.base = e.cls WHERE k < 8),
  members AS (SELECT up.cls || '.' || member AS target, arg_min(full_name, (k, full_name)) AS inherited FROM up JOIN methods m ON up.base = m.cls GROUP BY ALL),
  found AS (SELECT raw.*, q IS NOT NULL AS own, inherited, how IN ('module', 'symbol', 'name') AND NOT (string_split(target, '.')[1] IN (SELECT string_split(q, '.')[1] FROM names)) AS outside
    FROM raw LEFT JOIN names ON target = q LEFT JOIN members USING (target)),
  resolved AS (SELECT src AS src_qname, kind, file_path, own OR inherited IS NOT NULL OR outside AS resolved, outside,
    CASE WHEN own THEN target WHEN inherited IS NOT NULL THEN inherited WHEN how = 'symbol' AND outside THEN regexp_replace(target, '\\.[^.]*$', '') WHEN kind = 'imports' OR outside THEN target ELSE string_split(target, '.')[-1] END AS dst FROM found),
  kept AS (SELECT src_qname, dst, kind, resolved, file_path FROM resolved WHERE NOT (resolved AND outside))
  SELECT * FROM kept WHERE kind <> 'calls' UNION ALL SELECT DISTINCT * FROM kept WHERE kind = 'calls'"""


@register("references_incremental", PROJECT_SQL)
def references_incremental(spark, d):
    """The first version is resolved whole; then only what the second one changes, against stored rows."""
    nodes, raw = ([f(spark, d, v) for v in (1, 2)] for f in (project_nodes, project_raw))
    old, new = modules(spark, d, 1), modules(spark, d, 2)
    both = old.select("tier", "file_path", "shift").join(new.select("tier", "file_path", F.col("shift").alias("now")), resolution.FILE, "full_outer")
    files = both.where(~F.col("shift").eqNullSafe(F.col("now"))).select(*resolution.FILE)
    own = lambda rows: rows.join(files, resolution.FILE, "left_semi")
    save = Work(spark, folder(spark, "references")).save
    nodes, raw, files = [save(nodes[0]), nodes[1]], [save(raw[0]), raw[1]], save(files)
    before = resolution.resolve(raw[0], nodes[0], resolution.bases_of(raw[0], nodes[0]), save)
    again, after = resolution.maintained(files, nodes[0], save(own(nodes[1])), raw[0], save(own(raw[1])), save)
    return before.join(files.unionByName(again), resolution.FILE, "left_anti").unionByName(after).drop("tier")


@register("merged_table", """SELECT k, CASE WHEN k % 5 = 0 THEN 0 WHEN q IS NOT NULL THEN q ELSE round(o_totalprice) END::bigint AS v FROM (SELECT o_orderkey AS k, o_totalprice FROM orders)
  LEFT JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) USING (k) WHERE k % 7 <> 0 OR k % 5 = 0""")
def merged_table(spark, d):
    """Orders, then new values of those with returns, then some gone, then new rows; one bucket compacted in between."""
    store = Store(spark, folder(spark, "merged"), 8)
    table = Table(store, "orders", ["k"])
    orders = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("v"))
    table.replace(orders, store.snapshot())
    returned = t.read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("v"))
    table.upsert(returned)
    table.delete(orders.where("k % 7 = 0"))
    store.compact("orders", 3)
    table.upsert(orders.where("k % 5 = 0").withColumn("v", F.lit(0).cast("long")))
    return table.read()


@register("vector_topk_indexed", f"SELECT * FROM (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5")
def vector_topk_indexed(spark, d):
    """The audited cells, then those that a cell's radius doesn't rule out."""
    points = t.vectors(spark, d)
    index = vector_index.build(points, folder(spark, "vectors"), 64, k=5)
    queries = vector_index.queries_of(points.where("point_id % 50 = 0"), "point_id", "vector", 64)
    out = vector_index.batch_search(spark, index, queries, 5, exact=True, digits=6)
    return out.select("query_id", F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@register("path_roots", """WITH paths AS (SELECT '/data/r' || c_nationkey % 6 || '/n' || c_nationkey || '/c' || c_custkey || '.py' AS src FROM customer),
  roots AS (SELECT n_nationkey AS place, CASE WHEN n_nationkey % 4 = 0 THEN '/data/r' || n_regionkey ELSE '/data/r' || n_nationkey % 6 || '/n' || n_nationkey END AS root, n_name AS tier FROM nation)
  SELECT src, arg_min(tier, place) AS tier, arg_min(substr(src, length(root) + 2), place) AS file_path FROM paths LEFT JOIN roots ON starts_with(src, root || '/') GROUP BY src""")
def path_roots(spark, d):
    n = F.col("c_nationkey")
    paths = t.read(spark, d, "customer").select(name("/data/r", n % 6, "/n", n, "/c", F.col("c_custkey"), ".py").alias("src"))
    k = F.col("n_nationkey")
    root = F.when(k % 4 == 0, name("/data/r", F.col("n_regionkey"))).otherwise(name("/data/r", k % 6, "/n", k))
    roots = t.read(spark, d, "nation").select(k.alias("place"), root.alias("root"), F.col("n_name").alias("tier"))
    return watch.rooted(paths, roots)


@register("package_roots", """WITH paths AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'g' || c_nationkey || '/p' || c_custkey % 4 || '/__init__.py' WHEN c_custkey % 9 = 1 THEN 'g' || c_nationkey || '/__init__.py'
    ELSE 'g' || (c_nationkey + c_custkey % 2 * 30) || '/p' || c_custkey % 4 || '/s/m' || c_custkey || '.py' END AS file_path FROM customer WHERE c_custkey % 9 <> 1 OR c_nationkey % 3 = 0),
  files AS (SELECT DISTINCT file_path FROM paths), tops AS (SELECT regexp_replace(file_path, '/__init__\\.py$', '') AS directory FROM files WHERE ends_with(file_path, '/__init__.py')),
  found AS (SELECT f.file_path, min(len(string_split(directory, '/')) - 1) AS n FROM files f JOIN tops ON starts_with(f.file_path, directory || '/') GROUP BY f.file_path)
  SELECT file_path, replace(regexp_replace(regexp_replace(array_to_string(string_split(file_path, '/')[coalesce(n, 0) + 1:], '/'), '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM files LEFT JOIN found USING (file_path)""")
def package_roots(spark, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    path = F.when(k % 9 == 0, name("g", n, "/p", k % 4, "/__init__.py")).when(k % 9 == 1, name("g", n, "/__init__.py")).otherwise(name("g", n + k % 2 * 30, "/p", k % 4, "/s/m", k, ".py"))
    files = t.read(spark, d, "customer").where((k % 9 != 1) | (n % 3 == 0)).select(F.lit("t").alias("tier"), path.alias("file_path")).distinct()
    return tree.with_package_tops(files).select("file_path", graph.importable_name(F.col("file_path"), F.col("package_top")).alias("module"))


HEAL = f"""{W_}, {t.LEDGER_SQL}, led AS (SELECT tier, replace(file_path, '.md', '.py') AS file_path, state, n_chunks FROM ledger),
  live AS (SELECT tier, count(*) AS live FROM ledger JOIN (SELECT doc_id, unnest(l) FROM lined) USING (doc_id) WHERE state = 'indexed' AND NOT (tier = 'fr' AND doc_id % 2 = 0) GROUP BY tier),
  e AS (SELECT tier, sum(CASE WHEN state = 'indexed' THEN n_chunks ELSE 0 END)::bigint AS expected, bool_or(state = 'indexed' AND ends_with(file_path, '.py')) AS py FROM led GROUP BY tier)
  SELECT tier, coalesce(expected, 0) AS expected, coalesce(live, 0)::bigint AS live, CASE WHEN coalesce(expected, 0) <> coalesce(live, 0) THEN 'purge_and_reset' WHEN py AND tier <> 'en' THEN 'rebuild_graph' ELSE 'none' END AS action FROM e FULL JOIN live USING (tier)"""


@register("heal_plan", HEAL)
def heal_plan(spark, d):
    """What each tier needs, by the counts of ledger, points and graph: one has lost points, one alone has a graph."""
    ledger = t.ledger(spark, d)
    kept = ledger.where("state = 'indexed'").where("not (tier = 'fr' and doc_id % 2 = 0)")
    points = kept.select("tier", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))).alias("n")).where("n > 0")
    nodes = ledger.where("tier = 'en'").select("tier")
    return manifest.divergence(ledger.withColumn("file_path", F.replace("file_path", F.lit(".md"), F.lit(".py"))), points, nodes)


@register("sweep_outcomes", f"""SELECT tier, count(*) FILTER (action IN ('new', 'changed') AND ok) AS indexed, count(*) FILTER (action IN ('new', 'changed') AND NOT ok) AS failed,
  count(*) FILTER (action = 'unchanged') AS skipped, count(*) FILTER (action = 'purge') AS purged
  FROM ({SQL["manifest_diff"]}) LEFT JOIN ({OUT} SELECT tier, file_path, ok FROM oc) USING (tier, file_path) GROUP BY tier""")
def sweep_outcomes(spark, d):
    listing, ledger = snapshots(spark, d)
    return manifest.outcome_summary(listing, ledger, batch(spark, d)[1])


@register("indexed_files", f"{W_}, {t.LEDGER_SQL} SELECT tier, regexp_extract(file_path, '(\\.[^./]+)$', 1) AS suffix, count(*) AS n FROM ledger WHERE state = 'indexed' GROUP BY ALL")
def indexed_files(spark, d):
    return manifest.indexed_files(t.ledger(spark, d))


@register("memory_backfill", f"{NOTES} SELECT memory_id, any_value(text) AS text, any_value(refs_stamp) AS refs_stamp, coalesce(arg_max(metadata, (conv_id, turn)) FILTER (conv_id % 3 <> 0), '{{}}') AS metadata FROM led GROUP BY memory_id")
def memory_backfill(spark, d):
    """The ledger of two conversations in three, and points of all: what the ledger is after a restore."""
    notes = t.notes(spark, d)
    return memory.backfilled(memory.saved(notes.where("conv_id % 3 <> 0")), memory.as_points(memory.saved(notes)))


@register("minified_files", f"{W_} SELECT file_path, len(l) > 0 AND list_sum([length(x) FOR x IN l]) / greatest(1, len(l)) > 200 AS minified FROM lined WHERE ends_with(file_path, '.css')")
def minified_files(spark, d):
    files = t.files(spark, d).where(F.col("file_path").endswith(".css"))
    return files.select("file_path", text.is_minified(F.col("file_path"), lines(F.col("content")), "css").alias("minified"))
