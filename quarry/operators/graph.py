"""The code graph: nodes (kind, qualified_name, file_path, chunk_id, tier) and references (src_qname, dst, kind,
resolved, tier, file_path). Joins on names that match in several ways are made equi-joins on derived keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.keys import bare, dotted_prefixes, is_dunder, is_entry_module, is_test_path, module_of

NODE = ["kind", "qualified_name", "file_path", "chunk_id", "tier"]
USES = ["imports", "calls", "inherits"]


def keys_of(name: Column) -> Column:
    return F.array_distinct(F.array(name, bare(name)))


def importable_name(path: Column, top: Column) -> Column:
    """The dotted name of a Python file from the top of its package on, ``top`` leading directories left out."""
    parts = F.split(path, "/")
    return module_of(F.array_join(F.slice(parts, top + 1, F.size(parts)), "/"))


def derive_nodes(chunks: DataFrame) -> DataFrame:
    """Nodes of Python chunks: a module for each file, a class, method or function for each such chunk; repeats once."""
    module = module_of(F.col("file_path"))
    modules = chunks.select(F.lit("module").alias("kind"), module.alias("qualified_name"), "file_path", F.lit(None).cast("string").alias("chunk_id"), "tier", F.lit(-1).alias("_at")).distinct()
    named = chunks.where(F.col("chunk_type").isin("class", "method", "function"))
    base = F.regexp_replace("identity", "#[0-9]+$", "")
    named = named.select(F.col("chunk_type").alias("kind"), F.concat(module, F.lit("."), base).alias("qualified_name"), "file_path", F.col("point_id").alias("chunk_id"), "tier", F.col("line_start").alias("_at"))
    first = Window.partitionBy("tier", "file_path", "kind", "qualified_name").orderBy("_at", "chunk_id")
    return modules.unionByName(named).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*NODE)


def defines(chunks: DataFrame) -> DataFrame:
    """A reference from module to class or function, from class to method, for each chunk."""
    module = module_of(F.col("file_path"))
    rows = chunks.where(F.col("chunk_type").isin("class", "method", "function")).withColumn("_id", F.regexp_replace("identity", "#[0-9]+$", ""))
    owner = F.when(F.col("chunk_type") == "method", F.concat(module, F.lit("."), F.substring_index("_id", ".", 1))).otherwise(module)
    return rows.select(owner.alias("src_qname"), F.concat(module, F.lit("."), F.col("_id")).alias("dst"), F.lit("defines").alias("kind"), F.lit(True).alias("resolved"), "tier", "file_path")


def kept_references(refs: DataFrame) -> DataFrame:
    """References that are known to lead out of the project go; calls of one source are kept once."""
    rows = refs.where(~(F.col("resolved") & ~F.col("in_project"))).drop("in_project")
    calls = rows.where("kind = 'calls'").dropDuplicates(["tier", "file_path", "src_qname", "dst", "resolved"])
    return rows.where("kind <> 'calls'").unionByName(calls)


def what_imports(nodes: DataFrame, refs: DataFrame, target: str) -> DataFrame:
    """Modules that import the target, a symbol of its bare name, or anything below it."""
    leaf = target.rsplit(".", 1)[-1]
    hit = (bare(F.col("dst")) == leaf) | F.col("dst").startswith(target + ".")
    sources = refs.where((F.col("kind") == "imports") & hit).select(F.col("src_qname").alias("qualified_name"), "tier").distinct()
    return nodes.where("kind = 'module'").join(sources, ["qualified_name", "tier"], "left_semi").select(*NODE).distinct()


def references(nodes: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """One row: distinct sources in production and in tests (a source may be in both), and the nodes that refer."""
    leaf = name.rsplit(".", 1)[-1]
    rows = refs.where(F.col("kind").isin(USES) & F.col("dst").isin(name, leaf) & (F.col("src_qname") != name))
    test = is_test_path(F.col("file_path"))
    sources = rows.groupBy(F.col("src_qname").alias("qualified_name")).agg(F.max(~test).alias("production"), F.max(test).alias("test"))
    known = nodes.select("qualified_name").distinct().withColumn("node", F.lit(True))
    out = sources.join(known, "qualified_name", "left").agg(
        F.count_if("production").alias("production_references"),
        F.count_if("test").alias("test_references"),
        F.array_sort(F.collect_set(F.when(F.col("node"), F.col("qualified_name")))).alias("referencing"),
    )
    return out.select(F.lit(name).alias("qualified_name"), "*")


def sources_by_target(refs: DataFrame) -> DataFrame:
    """(dst, src_qname, test): distinct users of each name."""
    return refs.where(F.col("kind").isin(USES)).select("dst", "src_qname", is_test_path(F.col("file_path")).alias("test")).distinct()


def usage(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """Each candidate node with ``production`` and ``tests``: distinct sources under its full or bare name, less itself."""
    by_name = candidates.select("qualified_name").distinct().select("qualified_name", F.explode(keys_of(F.col("qualified_name"))).alias("dst"))
    used = by_name.join(sources_by_target(refs), "dst").where("src_qname <> qualified_name").select("qualified_name", "src_qname", "test").distinct()
    counts = used.groupBy("qualified_name").agg(F.count_if(~F.col("test")).alias("production"), F.count_if(F.col("test")).alias("tests"))
    return candidates.join(counts, "qualified_name", "left").fillna(0, ["production", "tests"])


def module_usage(modules: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Modules with the distinct sources of themselves and of all that is named below them."""
    pool = symbols.select("qualified_name").unionByName(modules.select("qualified_name")).distinct()
    below = pool.select("qualified_name", F.explode(dotted_prefixes(F.col("qualified_name"))).alias("module")).join(modules.select(F.col("qualified_name").alias("module")).distinct(), "module", "left_semi")
    named = below.select("module", "qualified_name", F.explode(keys_of(F.col("qualified_name"))).alias("dst"))
    used = named.join(sources_by_target(refs), "dst").where("src_qname <> qualified_name").select("module", "src_qname", "test").distinct()
    counts = used.groupBy(F.col("module").alias("qualified_name")).agg(F.count_if(~F.col("test")).alias("production"), F.count_if(F.col("test")).alias("tests"))
    return modules.join(counts, "qualified_name", "left").fillna(0, ["production", "tests"])


def dead_code(nodes: DataFrame, refs: DataFrame, tiers: list[str] | None = None, max_results: int = 100, include_tests: bool = False, include_dunders: bool = False, include_entrypoints: bool = False) -> DataFrame:
    """Nodes without a source in production, in order of name, at most max_results (1000)."""
    pool = nodes.where(F.col("tier").isin(tiers)) if tiers is not None else nodes
    rows = pool if include_tests else pool.where(~is_test_path(F.col("file_path")))
    rows = rows if include_dunders else rows.where(~((F.col("kind") == "method") & is_dunder(F.col("qualified_name"))))
    rows = rows if include_entrypoints else rows.where(~((F.col("kind") == "module") & is_entry_module(F.col("file_path"))))
    symbols = usage(rows.where("kind <> 'module'"), refs)
    modules = module_usage(rows.where("kind = 'module'"), pool.where("kind <> 'module'"), refs)
    dead = symbols.unionByName(modules).where("production = 0")
    reason = F.when(F.col("tests") > 0, "only_referenced_by_tests").otherwise("no_references")
    dead = dead.select(*NODE, F.col("tests").alias("test_references"), reason.alias("reason"))
    return dead.orderBy("qualified_name", "tier", "file_path", "kind").limit(min(max_results, 1000))


def tests_for(nodes: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """Nodes of test files that refer to the symbol, and tests named after it. A path stands for its module."""
    if symbol.endswith(".py"):
        symbol = symbol.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
    leaf = symbol.rsplit(".", 1)[-1]
    files = refs.where(F.col("dst").isin(symbol, leaf) & is_test_path(F.col("file_path"))).select("tier", "file_path").distinct()
    by_edge = nodes.join(files, ["tier", "file_path"], "left_semi")
    by_name = nodes.where(is_test_path(F.col("file_path")) & (bare(F.col("qualified_name")) == f"test_{leaf}"))
    return by_edge.unionByName(by_name).select(*NODE).distinct()


def blast_radius(nodes: DataFrame, refs: DataFrame, target: str, depth: int = 3, max_results: int = 50) -> DataFrame:
    """(hop, node): what depends on the target, breadth first, at most max_results names, in order of name within a hop.

    The frontier has at most max_results (500) names, so it is a list in each hop's filter, pushed to the scan.
    """
    spark, depth, max_results = nodes.sparkSession, min(depth, 25), min(max_results, 500)
    seen: dict[str, tuple] = {}
    frontier, found = [target], []
    for hop in range(1, max(0, depth) + 1):
        if not frontier or len(found) >= max_results:
            break
        names = sorted({n for f in frontier for n in (f, f.rsplit(".", 1)[-1])})
        hit = F.col("dst").isin(names)
        below = [f + "." for f in frontier if "." in f]
        if below:
            parents = F.slice(dotted_prefixes(F.col("dst")), 1, F.size(dotted_prefixes(F.col("dst"))) - 1)
            hit = hit | ((F.col("kind") == "imports") & F.arrays_overlap(parents, F.lit([b[:-1] for b in below])))
        sources = refs.where(hit).select(F.col("src_qname").alias("qualified_name")).where(~F.col("qualified_name").isin([target, *seen])).distinct()
        rows = nodes.join(sources, "qualified_name", "left_semi").groupBy("qualified_name").agg(F.min(F.struct("tier", "file_path", "kind", "chunk_id")).alias("n"))
        new = rows.orderBy("qualified_name").limit(max_results - len(found)).collect()
        frontier = [r["qualified_name"] for r in new]
        for r in new:
            seen[r["qualified_name"]] = ()
            found.append((hop, r["n"]["kind"], r["qualified_name"], r["n"]["file_path"], r["n"]["chunk_id"], r["n"]["tier"]))
    return spark.createDataFrame(found, "hop int, kind string, qualified_name string, file_path string, chunk_id string, tier string")
