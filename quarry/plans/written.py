"""Source files written from the tables, four suppliers a file, and what the chunkers make of them.

Where each chunk lies follows from a supplier's place in its file, so SQL tells the rows from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, graph, resolution
from quarry.plans import tables as t
from quarry.plans.catalogue import register

GROUP = 4


def put(text: str) -> Column:
    """A text with the columns s (supplier), n (nation), g (file) and i (place) put in where {s} and so on stand."""
    parts = [F.lit(text)]
    for name in "sngi":
        parts = [F.replace(parts[0], F.lit("{" + name + "}"), F.col(name).cast("string"))]
    return parts[0]


def written(spark: SparkSession, d: str, path: str, piece: str, head: str = "", tail: str = "") -> DataFrame:
    """(tier, file_path, content): a head, the suppliers' pieces in order, and a tail."""
    s = F.col("s_suppkey")
    rows = t.read(spark, d, "supplier").select(s.alias("s"), F.col("s_nationkey").alias("n"), F.floor(s / GROUP).alias("g"), (s % GROUP).alias("i"))
    files = rows.select("g", F.struct("i", put(piece).alias("x")).alias("p")).groupBy("g").agg(F.array_sort(F.collect_list("p")).alias("p"))  # GROUP at most
    files = files.withColumn("s", F.col("g") * GROUP).withColumn("n", F.lit(0)).withColumn("i", F.lit(0))
    content = F.concat(put(head), F.array_join(F.transform("p", lambda p: p["x"]), ""), put(tail))
    return files.select(F.lit("live").alias("tier"), put(path).alias("file_path"), content.alias("content"))


def chunks_of(files: DataFrame) -> DataFrame:
    out = chunking.chunk_files(files, chunking.default_registry())
    return out.select("file_path", "chunk_type", "identity", "sub_ordinal", "line_start", "line_end", F.to_json("metadata").alias("metadata"))


S_ = f"WITH s AS (SELECT s_suppkey AS s, s_nationkey AS n, s_suppkey // {GROUP} AS g, s_suppkey % {GROUP} AS i FROM supplier), f AS (SELECT g, count(*) AS n FROM s GROUP BY g)"


def row_sql(path: str, kind: str, identity: str, first: str, last: str, metadata: str = "'{}'", source: str = "s", sub: str = "0") -> str:
    return f"SELECT {path} AS file_path, '{kind}' AS chunk_type, {identity} AS identity, ({sub})::int AS sub_ordinal, ({first})::int AS line_start, ({last})::int AS line_end, {metadata} AS metadata FROM {source}"


def union(*parts: str) -> str:
    return S_ + " " + " UNION ALL ".join(parts)


PYTHON = ("p/g{g}.py", '\n\nclass S{s}:\n    """Supplier {s}."""\n\n    def pay(self):\n        return m{g}(1)\n\n\ndef use_{s}():\n    return S{s}().pay()\n', '"""Group {g}."""\nimport os\nfrom parts.m{g} import m{g}\n')
PARTS = ("parts/m{g}.py", "", "def m{g}(n):\n    return n\n")


def python_files(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, d, *PYTHON).unionByName(written(spark, d, *PARTS))


def python_json(cls: str = "''", method: str = "''") -> str:
    return f"""'{{"class_name":"' || {cls} || '","method_name":"' || {method} || '","inherits":"","decorators":""}}'"""


@register("python_chunks", union(
    row_sql("'p/g' || g || '.py'", "imports", "'imports'", "2", "3", python_json(), "f"),
    row_sql("'p/g' || g || '.py'", "class", "'S' || s", "6 + 11 * i", "7 + 11 * i", python_json("'S' || s")),
    row_sql("'p/g' || g || '.py'", "method", "'S' || s || '.pay'", "9 + 11 * i", "10 + 11 * i", python_json("'S' || s", "'pay'")),
    row_sql("'p/g' || g || '.py'", "function", "'use_' || s", "13 + 11 * i", "14 + 11 * i", python_json("''", "'use_' || s")),
    row_sql("'parts/m' || g || '.py'", "function", "'m' || g", "1", "2", python_json("''", "'m' || g"), "f"),
))
def python_chunks(spark, d):
    return chunks_of(python_files(spark, d))


@register("markdown_chunks", union(
    row_sql("'g' || g || '.md'", "markdown_section", "'G' || g", "3", "3", "'{\"heading_path\":\"G' || g || '\",\"token_count\":\"' || length('Group ' || g || ' of all.') // 4 || '\"}'", "f"),
    row_sql("'g' || g || '.md'", "markdown_section", "'G' || g || ' > S' || s", "7 + 4 * i", "7 + 4 * i", "'{\"heading_path\":\"G' || g || ' > S' || s || '\",\"token_count\":\"' || length('Nation ' || n || ' of S' || s || '.') // 4 || '\"}'"),
))
def markdown_chunks(spark, d):
    return chunks_of(written(spark, d, "g{g}.md", "## S{s}\n\nNation {n} of S{s}.\n\n", "# G{g}\n\nGroup {g} of all.\n\n"))


def sql_json(kind: str, tables: str, created: str) -> str:
    return f"""'{{"statement_type":"{kind}","referenced_tables":"' || {tables} || '","cte_names":"","created_object":"' || {created} || '","has_window_funcs":"false","leading_comment":"","dialect":"postgres"}}'"""


@register("sql_chunks", union(
    row_sql("'g' || g || '.sql'", "sql_statement", "'s' || s", "1 + 2 * i", "1 + 2 * i", sql_json("create", "'s' || s", "'s' || s")),
    row_sql("'g' || g || '.sql'", "sql_statement", "'stmt#' || (2 * i + 2)", "2 + 2 * i", "2 + 2 * i", sql_json("insert", "'base' || n || ',s' || s", "''")),
))
def sql_chunks(spark, d):
    return chunks_of(written(spark, d, "g{g}.sql", "CREATE TABLE s{s} (id int, total numeric);\nINSERT INTO s{s} SELECT id, total FROM base{n} WHERE total > {i};\n"))


@register("xml_chunks", union(row_sql("'g' || g || '.xml'", "xml_element", "'g' || g", "1", "n + 2", """'{"root_tag":"group","element_tag":"group","tag_path":"group","depth":"0","child_count":"' || n || '","namespaces":"","id_attr":"g' || g || '","name_attr":""}'""", "f")))
def xml_chunks(spark, d):
    return chunks_of(written(spark, d, "g{g}.xml", '<supplier id="s{s}"><name>Name {s}</name></supplier>\n', '<group id="g{g}">\n', "</group>"))


@register("js_chunks", union(
    row_sql("'g' || g || '.js'", "window", "'window#0'", "1", "2", source="f"),
    row_sql("'g' || g || '.js'", "js_function", "'f' || s", "3 + 4 * i", "5 + 4 * i"),
    row_sql("'g' || g || '.js'", "js_class", "'C' || g", "3 + 4 * n", "5 + 4 * n", source="f"),
))
def js_chunks(spark, d):
    return chunks_of(written(spark, d, "g{g}.js", "function f{s}() {\n  return {n};\n}\n\n", "import x from 'x';\n\n", "export class C{g} {\n  run() { f{s}(); }\n}\n"))


@register("css_chunks", f"{S_}, w AS (SELECT s, 150 + s % 7 * 60 AS n, unnest(range(1 + greatest(0, ceil((s % 7 * 60 - 50) / 160.0))::bigint)) AS k FROM s) " + row_sql("'s' || s || '.css'", "stylesheet", "'window#' || k", "160 * k + 1", "least(160 * k + 200, n)", source="w"))
def css_chunks(spark, d):
    """Style sheets of 150 to 510 lines, one a supplier."""
    s = F.col("s_suppkey")
    lines = F.transform(F.sequence(F.lit(0), (149 + s % 7 * 60).cast("int")), lambda k: F.concat(F.lit(".s"), k.cast("string"), F.lit(" { width: 1px; }\n")))
    return chunks_of(t.read(spark, d, "supplier").select(F.lit("live").alias("tier"), F.concat(F.lit("s"), s.cast("string"), F.lit(".css")).alias("file_path"), F.array_join(lines, "").alias("content")))


@register("text_chunks", union(row_sql("'g' || g || '.txt'", "text", "'window#0'", "1", "2 * n + 2", source="f")))
def text_chunks(spark, d):
    return chunks_of(written(spark, d, "g{g}.txt", "Supplier {s} is of nation {n}.\n\n", "Group {g}.\n\n"))


REFS_SQL = f"""{S_} SELECT 'p.g' || g AS src_qname, 'parts.m' || g || '.m' || g AS dst, 'imports' AS kind, true AS resolved, 'live' AS tier, 'p/g' || g || '.py' AS file_path FROM f
  UNION ALL SELECT 'parts.m' || g, 'parts.m' || g || '.m' || g, 'defines', true, 'live', 'parts/m' || g || '.py' FROM f
  UNION ALL SELECT 'p.g' || g, 'p.g' || g || '.S' || s, 'defines', true, 'live', 'p/g' || g || '.py' FROM s
  UNION ALL SELECT 'p.g' || g, 'p.g' || g || '.use_' || s, 'defines', true, 'live', 'p/g' || g || '.py' FROM s
  UNION ALL SELECT 'p.g' || g || '.S' || s, 'p.g' || g || '.S' || s || '.pay', 'defines', true, 'live', 'p/g' || g || '.py' FROM s
  UNION ALL SELECT 'p.g' || g || '.S' || s || '.pay', 'parts.m' || g || '.m' || g, 'calls', true, 'live', 'p/g' || g || '.py' FROM s
  UNION ALL SELECT 'p.g' || g || '.use_' || s, 'p.g' || g || '.S' || s, 'calls', true, 'live', 'p/g' || g || '.py' FROM s
  UNION ALL SELECT 'p.g' || g || '.use_' || s, 'pay', 'calls', false, 'live', 'p/g' || g || '.py' FROM s"""


@register("resolve_refs", REFS_SQL)
def resolve_refs(spark, d):
    files = python_files(spark, d)
    chunks = chunking.chunk_files(files, chunking.default_registry()).withColumn("point_id", F.concat_ws("#", "file_path", "identity"))
    return graph.defines(chunks).select(*resolution.REF).unionByName(chunking.resolved_references(files, graph.derive_nodes(chunks)))
