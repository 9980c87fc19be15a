"""The queries that the engine registers, by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import keys, text, vectors
from quarry.operators import chunking, graph, manifest, memory, search, symbols
from quarry.plans import tables as t
from quarry.sources import corpus
from quarry.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


F_ = f"WITH files AS ({t.FILES_SQL})"
W_ = f"{F_}, {t.WINDOWS_SQL}"
G_ = f"WITH {t.NODES_SQL}, {t.REFS_SQL}"
TEST = "(list_contains(list_slice(string_split(file_path, '/'), 1, len(string_split(file_path, '/')) - 1), 'tests') OR regexp_matches(string_split(file_path, '/')[-1], '^test_.*\\.py$|_test\\.py$'))"


@register("corpus_files", f"{W_} SELECT tier, file_path, strlen(content) AS size, sha256(content) AS sha256, len(l)::bigint AS n_lines FROM files JOIN lined USING (doc_id, tier, file_path)")
def corpus_files(spark, d):
    return corpus.corpus_files(t.files(spark, d)).drop("sha512")


INCLUDE, EXCLUDE = ["**/*.md", "src1?/*.txt"], ["src3/**", "**/*7.md"]


@register("include_filter", f"{F_} SELECT tier, file_path FROM files WHERE regexp_matches(file_path, '^(?:[^/]+/)*[^/]*\\.md$|^src1[^/]/[^/]*\\.txt$') AND NOT regexp_matches(file_path, '^src3/.*$|^(?:[^/]+/)*[^/]*7\\.md$')")
def include_filter(spark, d):
    return t.files(spark, d).where(corpus.is_included(F.col("file_path"), INCLUDE, EXCLUDE)).select("tier", "file_path")


@register("excluded_directories", f"{F_} SELECT tier, count(*) AS n FROM files WHERE NOT (list_contains(list_slice(string_split(file_path, '/'), 1, len(string_split(file_path, '/')) - 1), 'src1') OR list_contains(list_slice(string_split(file_path, '/'), 1, len(string_split(file_path, '/')) - 1), 'src2')) GROUP BY tier")
def excluded_directories(spark, d):
    return t.files(spark, d).where(~corpus.in_excluded_directory(F.col("file_path"), ("src1", "src2"))).groupBy("tier").agg(F.count("*").alias("n"))


@register("dispatch", f"{F_} SELECT file_path, CASE WHEN file_path LIKE '%.css' THEN 'text' WHEN starts_with(file_path, 'src1/') THEN 'special' WHEN file_path LIKE '%.md' THEN 'markdown' WHEN file_path LIKE '%.txt' THEN 'text' END AS chunker_key FROM files")
def dispatch(spark, d):
    registry = chunking.Registry()
    registry.register("markdown", [".md"])
    registry.register("text", [".txt"])
    registry.register("stylesheet", [".css"])
    registry.register("special", [], handles="^src1/")
    registry.override({".css": "text"})
    return t.files(spark, d).select("file_path", registry.key(F.col("file_path")).alias("chunker_key"))


@register("line_windows", f"{W_} SELECT file_path, identity, line_start, line_end, length(source_text)::bigint AS n_chars FROM win")
def line_windows(spark, d):
    return t.windows(t.files(spark, d)).select("file_path", "identity", "line_start", "line_end", F.length("source_text").cast("long").alias("n_chars"))


@register("chunk_points", f"{W_} SELECT {t.uuid_sql("'demo:' || tier || ':' || file_path || ':' || chunk_type || ':' || identity || ':' || sub_ordinal || ':2'")} AS point_id, tier, chunk_type, identity FROM win")
def chunk_points(spark, d):
    return t.points(t.windows(t.files(spark, d))).select("point_id", "tier", "chunk_type", "identity")


@register("records", f"{W_} SELECT file_path || '#' || identity AS k, 'File: ' || file_path || chr(10) || source_text AS embedding_text, sha256(source_text) AS content_hash FROM win")
def records(spark, d):
    rows = t.windows(t.files(spark, d))
    return rows.select(F.concat_ws("#", "file_path", "identity").alias("k"), chunking.embedding_text(F.concat(F.lit("File: "), F.col("file_path")), F.col("source_text")).alias("embedding_text"), F.sha2("source_text", 256).alias("content_hash"))


@register("token_counts", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::bigint AS tokens FROM documents")
def token_counts(spark, d):
    return t.read(spark, d, "documents").select("doc_id", text.n_tokens(F.col("text")).alias("tokens"))


@register("psql_lines", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with(ltrim(x), 'T') THEN '' ELSE x END), chr(10)) AS text FROM documents")
def psql_lines(spark, d):
    return t.read(spark, d, "documents").select("doc_id", chunking.blanked_lines(F.col("text"), "T").alias("text"))


@register("ordinals", f"{W_} SELECT file_path, identity, (row_number() OVER (PARTITION BY tier, length(source_text) ORDER BY file_path, sub_ordinal) - 1)::int AS nth FROM win")
def ordinals(spark, d):
    rows = t.windows(t.files(spark, d)).withColumn("n", F.length("source_text"))
    return chunking.with_ordinal(rows, ["tier", "n"], ["file_path", "sub_ordinal"], "nth").select("file_path", "identity", "nth")


@register("hash_embed", "WITH b AS (SELECT item_id, c, sha256(text || chr(0) || c) AS h FROM benchmark, range(4) r(c)), v AS (SELECT item_id, (c * 4 + k)::int AS pos, (('0x' || substr(h, (k * 16 + 1)::int, 16))::ubigint::decimal(20,0) - 9223372036854775808::decimal(20,0))::double AS x FROM b, range(4) s(k)) SELECT item_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 9) AS value FROM v")
def hash_embed(spark, d):
    rows = t.read(spark, d, "benchmark").select("item_id", F.posexplode(vectors.hash_embedding(F.col("text"), 16)).alias("pos", "x"))
    return rows.select("item_id", "pos", F.round("x", 9).alias("value"))


@register("mean_pool", "WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::double AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY ALL) SELECT label, pos::int AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m")
def mean_pool(spark, d):
    return vectors.mean_pooled(t.read(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


COS = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"


@register("vector_topk", f"SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id))::int AS rank FROM (SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3) ORDER BY rank LIMIT 10")
def vector_topk(spark, d):
    return ranked(search.top_k(t.vectors(spark, d), t.one_vector(spark, d, 3), 10))


@register("vector_topk_filtered", f"SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id))::int AS rank FROM (SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.label = 4) ORDER BY rank LIMIT 10")
def vector_topk_filtered(spark, d):
    return ranked(search.top_k(t.vectors(spark, d), t.one_vector(spark, d, 3), 10, {"label": 4}))


def ranked(hits: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "point_id"))  # k rows
    return hits.select(F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"), rank.alias("rank"))


@register("batch_topk", f"SELECT * FROM (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5")
def batch_topk(spark, d):
    rows = search.batch_top_k(t.vectors(spark, d), t.query_vectors(spark, d), 5)
    return rows.select("query_id", F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@register("filter_lookup", "SELECT vec_id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 8")
def filter_lookup(spark, d):
    return search.lookup(t.vectors(spark, d), {"label": 2}, 8, "point_id").select(F.col("point_id").alias("vec_id"), "label")


@register("vector_quarantine", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE len(embedding)::int END AS dim FROM embeddings")
def vector_quarantine(spark, d):
    v = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding").cast("array<double>"))
    return t.read(spark, d, "embeddings").select("vec_id", F.size(vectors.quarantined(v, 64)).alias("dim")).select("vec_id", F.when(F.col("dim") >= 0, F.col("dim")).alias("dim"))


SEARCH_SQL = f"""WITH hits AS (SELECT e.vec_id AS point_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) AS score, e.label FROM embeddings e, embeddings q WHERE q.vec_id = 3 ORDER BY score DESC, e.vec_id LIMIT 8),
  mem AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 0),
  b AS (SELECT point_id, label, score + CASE WHEN point_id IN (SELECT conv_id FROM mem) THEN 10 ELSE 0 END AS score FROM hits),
  s AS (SELECT b.*, coalesce(quality = 0, false) AS stale, CASE WHEN label % 5 IN (0, 1) THEN 'summary' ELSE 'source' END AS detail, (row_number() OVER (ORDER BY score DESC, point_id))::int AS rank FROM b LEFT JOIN labels ON doc_id = point_id)
  SELECT rank, point_id, round(score, 6) AS score, stale, detail, '[SOURCE:d' || point_id || ':' || (point_id % 100 + 1) || ']' || chr(10) || 'Key: ' || point_id || chr(10) || '```' || chr(10) || 'vector ' || point_id || chr(10) || '```'
    || CASE WHEN stale THEN chr(10) || '[STALE: the file has changed since it was indexed]' ELSE '' END AS formatted FROM s WHERE detail = 'source'"""


@register("search_pipeline", SEARCH_SQL)
def search_pipeline(spark, d):
    ledger = t.read(spark, d, "labels").select(F.lit("live").alias("tier"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("quality") == 0, "dirty").otherwise("indexed").alias("state"))
    refs = t.read(spark, d, "conversations").where("conv_id % 5 = 0").select(F.col("conv_id").alias("chunk_key"))
    out = search.search(t.vectors(spark, d), t.one_vector(spark, d, 3), ledger, refs, detail_level="source")
    return out.withColumn("score", F.round("score", 6))


def snapshots(spark, d):
    """The ledger of nine files in ten, and a listing of six in seven with some of them changed."""
    rows = t.files(spark, d).select("doc_id", "tier", "file_path", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("size"))
    ledger = rows.where("doc_id % 10 <> 0").withColumn("mtime_ns", F.col("doc_id")).withColumn("state", F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("indexed"))
    listing = rows.where("doc_id % 7 <> 0").withColumn("mtime_ns", F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return listing, ledger


SNAP = f"{F_}, rows AS (SELECT doc_id, tier, file_path, sha256(content) AS sha, strlen(content) AS size FROM files), led AS (SELECT *, doc_id AS mtime_ns, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'indexed' END AS state FROM rows WHERE doc_id % 10 <> 0), lst AS (SELECT *, doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime_ns FROM rows WHERE doc_id % 7 <> 0)"


@register("manifest_diff", f"{SNAP} SELECT tier, file_path, CASE WHEN l.doc_id IS NULL THEN 'purge' WHEN m.doc_id IS NULL THEN 'new' WHEN l.mtime_ns <> m.mtime_ns OR l.size <> m.size OR m.state <> 'indexed' THEN 'changed' ELSE 'unchanged' END AS action FROM lst l FULL JOIN led m USING (tier, file_path)")
def manifest_diff(spark, d):
    return manifest.diff(*snapshots(spark, d))


@register("reconcile_purge", f"{SNAP} SELECT tier, file_path FROM led ANTI JOIN lst USING (tier, file_path) WHERE tier IN ('en', 'de')")
def reconcile_purge(spark, d):
    return manifest.vanished(*snapshots(spark, d), ["en", "de"]).select("tier", "file_path")


def batch(spark, d):
    listing, ledger = snapshots(spark, d)
    ids = lambda n: F.transform(F.sequence(F.lit(1), (F.col("doc_id") % n + 1).cast("int")), lambda k: F.concat_ws("-", F.col("doc_id").cast("string"), k.cast("string")))
    ledger = ledger.withColumn("chunk_ids", ids(4)).withColumn("n_chunks", F.size("chunk_ids")).drop("doc_id")
    outcomes = listing.withColumn("ok", F.col("doc_id") % 6 != 0).withColumn("chunk_ids", ids(3)).drop("doc_id")
    return ledger, outcomes


IDS = "list_transform(generate_series(1, doc_id % {n} + 1), lambda k: doc_id || '-' || k)"
OUT = f"{SNAP}, old AS (SELECT tier, file_path, sha, mtime_ns, size, state, {IDS.format(n=4)} AS chunk_ids FROM led), oc AS (SELECT tier, file_path, sha, mtime_ns, size, doc_id % 6 <> 0 AS ok, {IDS.format(n=3)} AS chunk_ids FROM lst)"


@register("apply_batch", f"{OUT} SELECT tier, file_path, sha, mtime_ns, size, len(c)::int AS n_chunks, array_to_string(c, ',') AS chunk_ids, state FROM (SELECT tier, file_path, coalesce(oc.sha, old.sha) AS sha, coalesce(oc.mtime_ns, old.mtime_ns) AS mtime_ns, coalesce(oc.size, old.size) AS size, CASE WHEN oc.ok THEN oc.chunk_ids WHEN oc.ok IS NULL THEN old.chunk_ids ELSE coalesce(old.chunk_ids, []) END AS c, CASE WHEN oc.ok THEN 'indexed' WHEN oc.ok IS NULL THEN old.state ELSE 'failed' END AS state FROM old FULL JOIN oc USING (tier, file_path))")
def apply_batch(spark, d):
    return manifest.apply_outcomes(*batch(spark, d)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@register("stale_point_ids", f"{OUT} SELECT * FROM (SELECT tier, file_path, unnest(list_filter(old.chunk_ids, lambda x: NOT list_contains(oc.chunk_ids, x))) AS point_id FROM old JOIN oc USING (tier, file_path))")
def stale_point_ids(spark, d):
    ledger, outcomes = batch(spark, d)
    return manifest.stale_ids(ledger, outcomes)


@register("hash_skipped", f"{SNAP} SELECT l.tier, l.file_path FROM lst l JOIN led m USING (tier, file_path) WHERE m.state = 'indexed' AND l.sha = m.sha")
def hash_skipped(spark, d):
    listing, ledger = snapshots(spark, d)
    return manifest.skipped_by_hash(listing, ledger).select("tier", "file_path")


@register("index_status", f"{W_}, {t.LEDGER_SQL} SELECT count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'dirty') AS dirty, 0::bigint AS embedding, 0::bigint AS failed, coalesce(sum(n_chunks) FILTER (state = 'indexed'), 0)::bigint AS expected_chunks FROM ledger")
def index_status(spark, d):
    return manifest.status(t.ledger(spark, d))


@register("expected_vs_live", f"{W_}, {t.LEDGER_SQL}, e AS (SELECT tier, sum(CASE WHEN state = 'indexed' THEN n_chunks ELSE 0 END)::bigint AS expected FROM ledger GROUP BY tier), v AS (SELECT tier, count(*) AS live FROM win GROUP BY tier) SELECT tier, coalesce(expected, 0) AS expected, coalesce(live, 0) AS live, CASE WHEN coalesce(expected, 0) <> coalesce(live, 0) THEN 'purge_and_reset' ELSE 'none' END AS action FROM e FULL JOIN v USING (tier)")
def expected_vs_live(spark, d):
    return manifest.divergence(t.ledger(spark, d), t.windows(t.files(spark, d)))


@register("reset_tier", f"{W_}, {t.LEDGER_SQL} SELECT tier, CASE WHEN tier = 'fr' THEN 'dirty' ELSE state END AS state, count(*) AS n FROM ledger GROUP BY ALL")
def reset_tier(spark, d):
    return manifest.reset(t.ledger(spark, d), ["fr"]).groupBy("tier", "state").agg(F.count("*").alias("n"))


@register("what_imports", f"{G_} SELECT DISTINCT n.kind, n.qualified_name, n.file_path, n.chunk_id, n.tier FROM nodes n JOIN refs r ON r.src_qname = n.qualified_name AND r.tier = n.tier AND r.kind = 'imports' WHERE n.kind = 'module' AND (r.dst = 'part' OR r.dst LIKE '%.part' OR r.dst LIKE 'part.%')")
def what_imports(spark, d):
    return graph.what_imports(t.nodes(spark, d), t.refs(spark, d), "part")


@register("references", f"{G_}, u AS (SELECT src_qname, {TEST} AS test FROM refs WHERE kind IN ('imports', 'calls', 'inherits') AND dst IN ('part.p5', 'p5') AND src_qname <> 'part.p5') SELECT 'part.p5' AS qualified_name, count(DISTINCT src_qname) FILTER (NOT test) AS production_references, count(DISTINCT src_qname) FILTER (test) AS test_references, (SELECT coalesce(string_agg(DISTINCT qualified_name, ',' ORDER BY qualified_name), '') FROM nodes WHERE qualified_name IN (SELECT src_qname FROM u)) AS referencing FROM u")
def references(spark, d):
    return graph.references(t.nodes(spark, d), t.refs(spark, d), "part.p5").withColumn("referencing", F.array_join("referencing", ","))


DEAD = f"""{G_}, src AS (SELECT DISTINCT dst, src_qname, {TEST} AS test FROM refs WHERE kind IN ('imports', 'calls', 'inherits')),
  cand AS (SELECT * FROM nodes WHERE NOT {TEST}),
  named AS (SELECT qualified_name, qualified_name AS name FROM cand WHERE kind <> 'module' UNION SELECT m.qualified_name, s.qualified_name FROM cand m JOIN nodes s ON m.kind = 'module' AND (s.qualified_name = m.qualified_name OR starts_with(s.qualified_name, m.qualified_name || '.'))),
  keyed AS (SELECT DISTINCT qualified_name, name, k AS dst FROM (SELECT *, unnest([name, string_split(name, '.')[-1]]) AS k FROM named)),
  used AS (SELECT DISTINCT k.qualified_name, src_qname, test FROM keyed k JOIN src USING (dst) WHERE src_qname <> name),
  cnt AS (SELECT c.*, count(src_qname) FILTER (NOT test) AS production, count(src_qname) FILTER (test) AS tests FROM cand c LEFT JOIN used USING (qualified_name) GROUP BY ALL)"""


@register("dead_code", f"{DEAD} SELECT kind, qualified_name, file_path, chunk_id, tier, tests AS test_references, CASE WHEN tests > 0 THEN 'only_referenced_by_tests' ELSE 'no_references' END AS reason FROM cnt WHERE production = 0 AND NOT regexp_matches(qualified_name, '(^|[.])__[^.]+__$') ORDER BY qualified_name, tier, file_path, kind LIMIT 1000")
def dead_code(spark, d):
    return graph.dead_code(t.nodes(spark, d), t.refs(spark, d), ["live"], 1000)


@register("module_liveness", f"{DEAD} SELECT qualified_name, production, tests FROM cnt WHERE kind = 'module'")
def module_liveness(spark, d):
    nodes = t.nodes(spark, d)
    out = graph.module_usage(nodes.where("kind = 'module'"), nodes.where("kind <> 'module'"), t.refs(spark, d))
    return out.select("qualified_name", "production", "tests")


@register("tests_for", f"{G_}, f AS (SELECT DISTINCT tier, file_path FROM refs WHERE dst IN ('part.p4', 'p4') AND {TEST}) SELECT DISTINCT kind, qualified_name, file_path, chunk_id, tier FROM nodes WHERE (tier, file_path) IN (SELECT (tier, file_path) FROM f) OR ({TEST} AND string_split(qualified_name, '.')[-1] = 'test_p4')")
def tests_for(spark, d):
    return graph.tests_for(t.nodes(spark, d), t.refs(spark, d), "part.p4")


def hop(n: int) -> str:
    before = " UNION ALL ".join(["SELECT 'part.p1' AS q", *(f"SELECT qualified_name FROM h{k}" for k in range(1, n))])
    last = "SELECT 'part.p1' AS q" if n == 1 else f"SELECT qualified_name AS q FROM h{n - 1}"
    return f"""f{n} AS ({last}), k{n} AS (SELECT q FROM f{n} UNION SELECT string_split(q, '.')[-1] FROM f{n}), s{n} AS (SELECT DISTINCT src_qname FROM refs WHERE dst IN (SELECT q FROM k{n}) OR (kind = 'imports' AND EXISTS (SELECT 1 FROM f{n} WHERE contains(q, '.') AND starts_with(dst, q || '.')))),
  h{n} AS (SELECT DISTINCT qualified_name FROM nodes WHERE qualified_name IN (SELECT src_qname FROM s{n}) AND qualified_name NOT IN ({before}))"""


@register("blast_radius", f"{G_}, {hop(1)}, {hop(2)}, {hop(3)} SELECT hop, qualified_name FROM (SELECT 1::int AS hop, qualified_name FROM h1 UNION ALL SELECT 2, qualified_name FROM h2 UNION ALL SELECT 3, qualified_name FROM h3) ORDER BY hop, qualified_name LIMIT 500")
def blast_radius(spark, d):
    return graph.blast_radius(t.nodes(spark, d), t.refs(spark, d), "part.p1", 3, 500).select("hop", "qualified_name")


@register("symbol_lookup", f"{G_}, w AS (SELECT 'p' || item_id AS query FROM benchmark) SELECT query, qualified_name, file_path FROM (SELECT query, qualified_name, file_path, row_number() OVER (PARTITION BY query ORDER BY list_position(['class','method','function'], kind), tier, file_path, qualified_name) AS n FROM w JOIN nodes ON query = string_split(qualified_name, '.')[-1] AND kind IN ('class','method','function')) WHERE n = 1")
def symbol_lookup(spark, d):
    wanted = t.read(spark, d, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("query"))
    return symbols.lookup_names(t.nodes(spark, d), wanted)


@register("graph_files", f"{G_} SELECT count(DISTINCT (tier, file_path)) AS n FROM nodes")
def graph_files(spark, d):
    return t.nodes(spark, d).agg(F.count_distinct(F.struct("tier", "file_path")).alias("n"))


@register("call_dedupe", f"{G_} SELECT kind, count(*) AS n FROM (SELECT DISTINCT kind, tier, file_path, src_qname, dst, resolved FROM refs WHERE kind = 'calls' AND NOT (resolved AND dst LIKE '%9') UNION ALL SELECT kind, tier, file_path, src_qname, dst, resolved FROM refs WHERE kind <> 'calls' AND NOT (resolved AND dst LIKE '%9')) GROUP BY kind")
def call_dedupe(spark, d):
    refs = graph.kept_references(t.refs(spark, d).withColumn("in_project", ~F.col("dst").endswith("9")))
    return refs.groupBy("kind").agg(F.count("*").alias("n"))


@register("read_spans", f"""{W_}, w AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'xx' ELSE tier END AS tier, CASE WHEN doc_id % 17 = 0 THEN '../' || file_path WHEN doc_id % 19 = 0 THEN 'no/' || file_path ELSE file_path END AS path, (doc_id % 4)::int AS a, (doc_id % 9 + 1)::int AS b FROM files),
  j AS (SELECT w.*, l FROM w LEFT JOIN lined x ON w.tier = x.tier AND w.path = x.file_path), e AS (SELECT *, CASE WHEN tier = 'xx' THEN 'unknown_tier' WHEN starts_with(path, '../') THEN 'outside' WHEN l IS NULL THEN 'missing' WHEN a < 1 OR a > len(l) OR b < a THEN 'bad_range' END AS error_kind FROM j)
  SELECT tier, path, CASE WHEN error_kind IS NULL THEN a END AS line_start, CASE WHEN error_kind IS NULL THEN least(b, len(l))::int END AS line_end, CASE WHEN error_kind IS NULL THEN array_to_string(l[a:least(b, len(l))], chr(10)) END AS text, error_kind FROM e""")
def read_spans(spark, d):
    files = t.files(spark, d)
    path = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("../"), "file_path")).when(F.col("doc_id") % 19 == 0, F.concat(F.lit("no/"), "file_path")).otherwise(F.col("file_path"))
    wanted = files.select(F.when(F.col("doc_id") % 13 == 0, "xx").otherwise(F.col("tier")).alias("tier"), path.alias("path"), (F.col("doc_id") % 4).cast("int").alias("line_start"), (F.col("doc_id") % 9 + 1).cast("int").alias("line_end"))
    return symbols.read_spans(wanted, files, ["en", "de", "fr", "es"])


@register("snapshot_resolve", f"{F_} SELECT CASE WHEN doc_id % 2 = 0 THEN 'pip' ELSE tier END AS tier, 'd' || doc_id AS path, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'pip-packages/d' || doc_id WHEN doc_id % 2 = 0 THEN 'apt-packages/d' || doc_id WHEN doc_id % 5 = 0 THEN tier || '/d' || doc_id END AS found FROM files")
def snapshot_resolve(spark, d):
    files = t.files(spark, d)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    wanted = files.select(F.when(F.col("doc_id") % 2 == 0, "pip").otherwise(F.col("tier")).alias("tier"), path.alias("path"))
    places = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "pip-packages"), F.when(F.col("doc_id") % 2 == 0, "apt-packages"), F.when(F.col("doc_id") % 5 == 0, F.col("tier"))))
    present = files.select(F.explode(places).alias("p"), path.alias("path")).select(F.concat_ws("/", "p", "path").alias("file_path"))
    return corpus.resolve(wanted, present)


NOTES = f"WITH n AS (SELECT text, 'c' || conv_id || '@1' AS refs_stamp, role AS metadata, conv_id, turn FROM conversations), led AS (SELECT {t.uuid_sql("'memory:' || text || ':' || refs_stamp")} AS memory_id, text, refs_stamp, metadata, conv_id, turn FROM n)"


@register("memory_save", f"{NOTES} SELECT memory_id, any_value(text) AS text, any_value(refs_stamp) AS refs_stamp, arg_max(metadata, (conv_id, turn)) AS metadata FROM led GROUP BY memory_id")
def memory_save(spark, d):
    return memory.saved(t.notes(spark, d))


@register("memory_restore", f"{NOTES} SELECT DISTINCT memory_id, refs_stamp FROM led WHERE conv_id % 3 = 0 AND memory_id NOT IN (SELECT memory_id FROM led WHERE conv_id % 3 <> 0)")
def memory_restore(spark, d):
    notes = t.notes(spark, d)
    return memory.missing(memory.saved(notes), memory.saved(notes.where("conv_id % 3 <> 0"))).select("memory_id", "refs_stamp")


RECALL_SQL = f"""{NOTES}, own AS (SELECT DISTINCT memory_id, text FROM led), words AS (SELECT text FROM own UNION SELECT text FROM benchmark),
  blocks AS (SELECT text, c, sha256(text || chr(0) || c) AS h FROM words, range(8) r(c)),
  vec AS (SELECT text, list((('0x' || substr(h, (k * 16 + 1)::int, 16))::ubigint::decimal(20,0) - 9223372036854775808::decimal(20,0))::double ORDER BY c * 4 + k) AS v FROM blocks, range(4) q(k) GROUP BY text),
  near AS (SELECT item_id AS query_id, memory_id, list_cosine_similarity(a.v, b.v) AS score FROM benchmark JOIN vec a USING (text), own JOIN vec b USING (text))
  SELECT query_id, memory_id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id))::int AS rank FROM near) WHERE rank <= 5"""


@register("memory_recall", RECALL_SQL)
def memory_recall(spark, d):
    points = memory.embedded(memory.saved(t.notes(spark, d)), 32)
    queries = t.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), vectors.hash_embedding(F.col("text"), 32).alias("v"))
    return memory.recall(points, queries, 5).withColumn("score", F.round("score", 6))


@register("debounce_ops", "WITH o AS (SELECT user_id::varchar AS file_path, CASE WHEN event_type = 'error' THEN 'purge' ELSE 'index' END AS op, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY file_path ORDER BY ts, event_id) AS n_session FROM o) SELECT file_path, min(ts) AS started, max(ts) + INTERVAL 1 DAY AS ended, arg_max(op, (ts, event_id)) AS op, count(*) AS n FROM s GROUP BY file_path, n_session")
def debounce_ops(spark, d):
    return changes.debounced(t.change_events(spark, d), "1 day").drop("tier")


@register("apply_event_ops", "SELECT user_id::varchar AS file_path, CASE WHEN user_id % 4 = 0 THEN 'purge' ELSE arg_max(CASE WHEN event_type = 'error' THEN 'purge' ELSE 'index' END, (ts, event_id)) END AS op FROM events GROUP BY user_id")
def apply_event_ops(spark, d):
    ops = t.change_events(spark, d)
    listing = ops.where("cast(file_path as long) % 4 <> 0").select("tier", "file_path").distinct()
    return changes.checked_against(changes.final_operations(ops), listing).select("file_path", "op")


@register("event_operations", "SELECT path AS file_path, op, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type = 'click' THEN [{'path': 'a' || user_id, 'op': 'purge'}, {'path': 'b' || user_id, 'op': 'index'}] WHEN event_type = 'error' THEN [{'path': 'a' || user_id, 'op': 'purge'}] ELSE [{'path': 'a' || user_id, 'op': 'index'}] END, recursive := true) FROM events) GROUP BY ALL")
def event_operations(spark, d):
    rows = t.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    user = F.col("user_id").cast("string")
    events = rows.select(F.lit("live").alias("tier"), kind.alias("event"), F.concat(F.lit("a"), user).alias("src"), F.concat(F.lit("b"), user).alias("dest"), "ts", F.col("event_id").alias("seq"))
    return changes.operations(events).groupBy("file_path", "op").agg(F.count("*").alias("n"))


@register("redact_labels", "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***', 'g'), '(?i)\\b(api[_-]?key|token|secret|password)\\b(\\s*[:=]\\s*)(\"[^\"]*\"|''[^'']*''|[^\\s,;]+)', '\\1\\2***', 'g') AS text FROM documents")
def redact_labels(spark, d):
    return t.read(spark, d, "documents").select("doc_id", text.without_labels(F.col("text")).alias("text"))


ENTROPY_SQL = "list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: -(len(list_filter(string_split(w, ''), lambda y: y = c)) / length(w)) * log2(len(list_filter(string_split(w, ''), lambda y: y = c)) / length(w))))"
LONG = "'[A-Za-z0-9+/_=-]{24,}'"


@register("redact", f"""WITH l AS ({SQL['redact_labels']}), f AS (SELECT doc_id, text, regexp_extract_all(text, {LONG}) AS found, regexp_split_to_array(text, {LONG}) AS gaps FROM l),
  m AS (SELECT *, list_transform(found, lambda w: CASE WHEN {ENTROPY_SQL} >= 3.5 THEN '***' ELSE w END) AS masked FROM f)
  SELECT doc_id, CASE WHEN len(found) > 0 THEN array_to_string(list_transform(list_zip(gaps, masked), lambda z: z[1] || coalesce(z[2], '')), '') ELSE text END AS text FROM m""")
def redact(spark, d):
    return t.read(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("text"))


@register("token_entropy", "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS m FROM c WHERE c <> '' GROUP BY doc_id, c), e AS (SELECT doc_id, round(-sum(n / m * log2(n / m)), 6) AS entropy FROM n GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(entropy, 0) END AS entropy FROM documents LEFT JOIN e USING (doc_id)")
def token_entropy(spark, d):
    return t.read(spark, d, "documents").select("doc_id", F.round(text.entropy(F.col("text")), 6).alias("entropy"))


MODULE = "replace(regexp_replace(regexp_replace(p, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.')"


@register("module_names", f"SELECT p AS file_path, {MODULE} AS module, string_split({MODULE}, '.')[-1] AS bare FROM (SELECT 'src/a' || c_custkey % 50 || CASE WHEN c_custkey % 3 = 0 THEN '/__init__.py' ELSE '/m' || c_custkey || '.py' END AS p FROM customer)")
def module_names(spark, d):
    k = F.col("c_custkey")
    p = F.concat(F.lit("src/a"), (k % 50).cast("string"), F.when(k % 3 == 0, "/__init__.py").otherwise(F.concat(F.lit("/m"), k.cast("string"), F.lit(".py"))))
    rows = t.read(spark, d, "customer").select(p.alias("file_path"))
    return rows.select("file_path", keys.module_of(F.col("file_path")).alias("module"), keys.bare(keys.module_of(F.col("file_path"))).alias("bare"))


@register("document_chunks")
def document_chunks(spark, d):
    """All documents by the chunkers of their suffixes."""
    return chunking.chunk_files(t.files(spark, d).drop("doc_id"), chunking.default_registry())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, line windows, stable keys, hash embedding, the nearest chunks to a text, with citations."""
    chunks = t.points(t.windows(t.files(spark, sf_dir)))
    dim = 16
    vector = vectors.hash_embedding(chunking.embedding_text(F.lit(""), F.col("source_text")), dim)
    points = chunks.withColumn("vector", vector)
    query = spark.range(1).select(vectors.hash_embedding(F.lit("where is the clock"), dim).alias("v")).first()["v"]
    hits = manifest.flag_stale(search.top_k(points, list(query), 8), t.ledger(spark, sf_dir))
    text_ = search.citation(F.col("file_path"), F.col("line_start"), F.col("point_id"), F.col("source_text"), F.col("stale"))
    return hits.select("point_id", F.round("score", 6).alias("score"), "stale", text_.alias("formatted"))


from quarry.plans import evolving, written  # noqa: E402, F401  they register queries of their own
