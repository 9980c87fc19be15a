"""The engine's relations made from the provided tables, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.keys import point_id
from quarry.functions.text import lines, window_starts

SLUG = "demo"
SIZE, STEP = 12, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: tier is the language, the suffix follows doc_id."""
    docs = read(spark, sf_dir, "documents")
    suffix = F.element_at(F.lit(["md", "txt", "css"]), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    return docs.select("doc_id", F.col("lang").alias("tier"), path.alias("file_path"), F.col("text").alias("content"))


FILES_SQL = """SELECT doc_id, lang AS tier, source || '/d' || doc_id || '.' || (['md','txt','css'])[(doc_id % 3 + 1)::int] AS file_path, text AS content FROM documents"""


def windows(rows: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """Line windows of files as chunks: window#N, from the first line to one that reaches the end. In-row, no shuffle."""
    parts = rows.withColumn("_l", lines(F.col("content")))
    starts = parts.select("doc_id", "tier", "file_path", "_l", F.posexplode(window_starts(F.size("_l"), size, step)).alias("n", "start"))
    end = F.least(F.col("start") + size, F.size("_l"))
    text = F.array_join(F.slice("_l", F.col("start") + 1, F.lit(size)), "\n")
    return starts.select("doc_id", "tier", "file_path", F.lit("text").alias("chunk_type"), F.concat(F.lit("window#"), F.col("n").cast("string")).alias("identity"), F.col("n").alias("sub_ordinal"), (F.col("start") + 1).alias("line_start"), end.alias("line_end"), text.alias("source_text"))


WINDOWS_SQL = f"""
  lined AS (SELECT doc_id, tier, file_path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (
    SELECT doc_id, tier, file_path, string_split_regex(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM files)),
  win AS (SELECT doc_id, tier, file_path, 'text' AS chunk_type, 'window#' || n AS identity, n::int AS sub_ordinal, (n * {STEP} + 1)::int AS line_start,
    least(n * {STEP} + {SIZE}, len(l))::int AS line_end, array_to_string(l[n * {STEP} + 1 : n * {STEP} + {SIZE}], chr(10)) AS source_text
    FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((len(l) - {SIZE}) / {STEP}.0))::bigint)) AS n FROM lined WHERE len(l) > 0))"""


def points(rows: DataFrame) -> DataFrame:
    return rows.withColumn("point_id", point_id(SLUG, F.col("tier"), F.col("file_path"), F.col("chunk_type"), F.col("identity"), F.col("sub_ordinal")))


UUID_SQL = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||(['8','9','a','b'])[(('0x'||substr(h,17,1))::int % 4) + 1]||substr(h,18,3)||'-'||substr(h,21,12)"


def uuid_sql(name: str) -> str:
    return f"(SELECT {UUID_SQL} FROM (SELECT sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({name})) AS h))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: type, path and tier from label and id."""
    rows = read(spark, sf_dir, "embeddings")
    kind = F.element_at(F.lit(["imports", "class", "method", "function", "text"]), (F.col("label") % 5 + 1).cast("int"))
    return rows.select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.col("label"), F.lit("live").alias("tier"),
        F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("file_path"), kind.alias("chunk_type"), (F.col("vec_id") % 100 + 1).cast("int").alias("line_start"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("source_text"),
    )


def one_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, v): the stated queries of a batch, every row whose id is divisible by 50."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as modules, suppliers as classes in them with a method that nothing uses and one that Python calls, parts as
    functions of one module, and test functions.
    """
    node = lambda kind, name, path: [F.lit(kind).alias("kind"), name.alias("qualified_name"), path.alias("file_path"), F.lit(None).cast("string").alias("chunk_id"), F.lit("live").alias("tier")]
    c = lambda *x: F.concat(*(F.lit(p) if not p.startswith("$") else F.col(p[1:]).cast("string") for p in x))
    nation, supplier, part = (read(spark, sf_dir, t) for t in ("nation", "supplier", "part"))
    modules = nation.select(*node("module", c("nation.n", "$n_nationkey"), c("src/nation/n", "$n_nationkey", ".py")))
    classes = supplier.select(*node("class", c("nation.n", "$s_nationkey", ".S", "$s_suppkey"), c("src/nation/n", "$s_nationkey", ".py")))
    functions = part.select(*node("function", c("part.p", "$p_partkey"), F.lit("src/part.py")))
    tests = nation.select(*node("function", c("tests.test_n", "$n_nationkey", ".test_p", "$n_nationkey"), c("tests/test_n", "$n_nationkey", ".py")))
    methods = [supplier.select(*node("method", c("nation.n", "$s_nationkey", ".S", "$s_suppkey", f".{m}"), c("src/nation/n", "$s_nationkey", ".py"))) for m in ("unused", "__len__")]
    classes = classes.unionByName(methods[0]).unionByName(methods[1])
    top = spark.range(1).select(*node("module", F.lit("part"), F.lit("src/part.py")))
    return modules.unionByName(classes).unionByName(functions).unionByName(tests).unionByName(top)


NODES_SQL = """nodes AS (
    SELECT 'module' AS kind, 'nation.n' || n_nationkey AS qualified_name, 'src/nation/n' || n_nationkey || '.py' AS file_path, NULL::varchar AS chunk_id, 'live' AS tier FROM nation
    UNION ALL SELECT 'class', 'nation.n' || s_nationkey || '.S' || s_suppkey, 'src/nation/n' || s_nationkey || '.py', NULL, 'live' FROM supplier
    UNION ALL SELECT 'method', 'nation.n' || s_nationkey || '.S' || s_suppkey || m, 'src/nation/n' || s_nationkey || '.py', NULL, 'live' FROM supplier, (VALUES ('.unused'), ('.__len__')) v(m)
    UNION ALL SELECT 'function', 'part.p' || p_partkey, 'src/part.py', NULL, 'live' FROM part
    UNION ALL SELECT 'function', 'tests.test_n' || n_nationkey || '.test_p' || n_nationkey, 'tests/test_n' || n_nationkey || '.py', NULL, 'live' FROM nation
    UNION ALL SELECT 'module', 'part', 'src/part.py', NULL, 'live')"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls of parts by suppliers' classes (in tests if returned), imports, inheritance, definitions."""
    lineitem, supplier, nation = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    n = lambda col: F.concat(F.lit("nation.n"), F.col(col).cast("string"))
    own = supplier.select("s_suppkey", "s_nationkey", F.concat(n("s_nationkey"), F.lit(".S"), F.col("s_suppkey").cast("string")).alias("src_qname"), F.concat(F.lit("src/nation/n"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("file"))
    out = lambda df, kind, src, dst, resolved, path: df.select(src.alias("src_qname"), dst.alias("dst"), F.lit(kind).alias("kind"), resolved.alias("resolved"), F.lit("live").alias("tier"), path.alias("file_path"))
    third = F.col("l_linenumber") % 3 == 0
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    path = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("tests/test_n"), F.col("s_nationkey").cast("string"), F.lit(".py"))).otherwise(F.col("file"))
    calls = out(lineitem.join(own, F.col("l_suppkey") == F.col("s_suppkey")), "calls", F.col("src_qname"), F.when(third, part).otherwise(F.concat(F.lit("part."), part)), ~third, path)
    imports = out(own, "imports", n("s_nationkey"), F.concat(F.lit("part.p"), F.col("s_suppkey").cast("string")), F.lit(True), F.col("file"))
    inherits = out(nation, "inherits", n("n_nationkey"), F.concat(F.lit("region.r"), F.col("n_regionkey").cast("string")), F.lit(True), F.concat(F.lit("src/nation/n"), F.col("n_nationkey").cast("string"), F.lit(".py")))
    defines = out(own, "defines", n("s_nationkey"), F.col("src_qname"), F.lit(True), F.col("file"))
    return calls.unionByName(imports).unionByName(inherits).unionByName(defines)


REFS_SQL = """own AS (SELECT s_suppkey, s_nationkey, 'nation.n' || s_nationkey || '.S' || s_suppkey AS src_qname, 'src/nation/n' || s_nationkey || '.py' AS file FROM supplier),
  refs AS (
    SELECT src_qname, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'part.' END || 'p' || l_partkey AS dst, 'calls' AS kind, l_linenumber % 3 <> 0 AS resolved, 'live' AS tier,
      CASE WHEN l_returnflag = 'R' THEN 'tests/test_n' || s_nationkey || '.py' ELSE file END AS file_path
      FROM lineitem JOIN own ON l_suppkey = s_suppkey
    UNION ALL SELECT 'nation.n' || s_nationkey, 'part.p' || s_suppkey, 'imports', true, 'live', file FROM own
    UNION ALL SELECT 'nation.n' || n_nationkey, 'region.r' || n_regionkey, 'inherits', true, 'live', 'src/nation/n' || n_nationkey || '.py' FROM nation
    UNION ALL SELECT 'nation.n' || s_nationkey, src_qname, 'defines', true, 'live', file FROM own)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as ledger rows: quality 0 is dirty; as many chunks as windows of 20 lines."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = files(spark, sf_dir).join(labels, "doc_id")
    n = F.size(lines(F.col("content")))
    return rows.select("doc_id", "tier", "file_path", F.sha2("content", 256).alias("sha"), F.col("doc_id").alias("mtime_ns"), F.octet_length("content").cast("long").alias("size"), n.alias("n_chunks"), F.when(F.col("quality") == 0, "dirty").otherwise("indexed").alias("state"))


LEDGER_SQL = """ledger AS (SELECT f.doc_id, tier, file_path, sha256(content) AS sha, f.doc_id AS mtime_ns, strlen(content) AS size, len(l)::int AS n_chunks,
    CASE WHEN quality = 0 THEN 'dirty' ELSE 'indexed' END AS state FROM files f JOIN labels USING (doc_id) JOIN (SELECT doc_id, l FROM lined) USING (doc_id))"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes; each refers to its conversation."""
    rows = read(spark, sf_dir, "conversations")
    refs_ = F.array(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chunk_key"), F.lit(1).alias("key_version")))
    return rows.select("text", refs_.alias("refs"), F.col("role").alias("metadata"), F.struct("conv_id", "turn").alias("seq"), "conv_id", "turn")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on the users' files: errors purge, all else indexes."""
    rows = read(spark, sf_dir, "events")
    return rows.select(F.lit("live").alias("tier"), F.col("user_id").cast("string").alias("file_path"), F.when(F.col("event_type") == "error", "purge").otherwise("index").alias("op"), "ts", F.col("event_id").alias("seq"))
