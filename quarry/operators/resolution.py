"""References resolved against a project's own names, all at once or only where a change can touch them.

Raw references (tier, file_path, src_qname, kind, how, target) are what the files themselves tell, and are stored. What
one of them resolves to depends on four things alone: whether its target is a name of the project, whether the first
part of the target is, and, for a member of a class, the methods of that class and of its bases. After a change of some
files the names, first parts and classes that came, went or changed are found from these files' rows; only files with a
reference to one of them are resolved again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import kept_references

FILE = ["tier", "file_path"]
RAW = "tier string, file_path string, src_qname string, kind string, how string, target string"
REF = ["src_qname", "dst", "kind", "resolved", "tier", "file_path"]
#: Steps from a class to its bases.
DEPTH = 8
#: How a table that several plans read is kept: by default in memory and on disk; better written, which cuts its lineage.
Save = Callable[[DataFrame], DataFrame]


def kept(rows: DataFrame) -> DataFrame:
    return rows.persist()


def top(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def parent(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def bases_of(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, base): the bases that are names of the project."""
    names = nodes.select(F.col("qualified_name").alias("target")).distinct()
    return raw.where("kind = 'inherits'").join(names, "target", "left_semi").select(F.col("src_qname").alias("cls"), F.col("target").alias("base")).distinct()


def inherited(nodes: DataFrame, bases: DataFrame, wanted: DataFrame | None = None, depth: int = DEPTH, save: Save = kept) -> DataFrame:
    """(cls, member, full): members that a class has from its bases, the nearest first; of the classes ``wanted`` (cls)."""
    methods = nodes.where("kind = 'method'").select(parent(F.col("qualified_name")).alias("base"), F.substring_index("qualified_name", ".", -1).alias("member"), F.col("qualified_name").alias("full")).distinct()
    bases = save(bases)
    up = bases.select(F.col("cls").alias("base"), F.col("base").alias("next"))
    step = bases if wanted is None else save(bases.join(wanted.select("cls").distinct(), "cls", "left_semi"))
    found = []
    for k in range(1, depth + 1):
        found.append(step.join(methods, "base").select("cls", "member", "full", F.lit(k).alias("k")))
        if k == depth:
            break
        step = save(step.join(up, "base").select("cls", F.col("next").alias("base")).distinct())
        if step.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).groupBy("cls", "member").agg(F.min_by("full", F.struct("k", "full")).alias("full"))


def resolve(raw: DataFrame, nodes: DataFrame, bases: DataFrame, save: Save = kept) -> DataFrame:
    """References (src_qname, dst, kind, resolved, tier, file_path) of raw ones, with the names of all files.

    A symbol imported from a module outside the project becomes a reference to that module; a method is looked for in
    its class, then in the class's bases; what can't be told keeps its last name, unresolved. References that are
    known to lead outside are dropped.
    """
    names = nodes.select(F.col("qualified_name").alias("target")).distinct().withColumn("own", F.lit(True))
    tops = nodes.select(top(F.col("qualified_name")).alias("top")).distinct().withColumn("project", F.lit(True))
    members = inherited(nodes, bases, raw.select(parent(F.col("target")).alias("cls")), save=save)
    members = members.select(F.concat_ws(".", "cls", "member").alias("target"), "full")
    rows = raw.withColumn("top", top(F.col("target"))).join(names, "target", "left").join(tops, "top", "left").join(members, "target", "left")
    outside = F.col("how").isin("module", "symbol", "name") & F.col("project").isNull()
    known = F.col("own").isNotNull() | F.col("full").isNotNull()
    dst = (
        F.when(F.col("own"), F.col("target"))
        .when(F.col("full").isNotNull(), F.col("full"))
        .when((F.col("how") == "symbol") & outside, parent(F.col("target")))
        .when(F.col("kind") == "imports", F.col("target"))
        .otherwise(F.when(outside, F.col("target")).otherwise(F.substring_index("target", ".", -1)))
    )
    out = rows.select("src_qname", dst.alias("dst"), "kind", (known | outside).alias("resolved"), (~outside).alias("in_project"), *FILE)
    return kept_references(out).select(*REF)


def symmetric(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one of the two alone."""
    old, new = old.distinct(), new.distinct()
    return old.join(new, old.columns, "left_anti").unionByName(new.join(old, old.columns, "left_anti"))


def subclasses(classes: DataFrame, bases: DataFrame, depth: int = DEPTH, save: Save = kept) -> DataFrame:
    """(cls): the classes and all that have one of them as a base, directly or not."""
    step = save(classes.select("cls").distinct())
    if step.isEmpty():
        return step
    found, bases = [step], save(bases)
    for _ in range(depth):
        step = save(bases.join(step.select(F.col("cls").alias("base")), "base", "left_semi").select("cls").distinct())
        if step.isEmpty():
            break
        found.append(step)
    return reduce(DataFrame.unionByName, found).distinct()


def touched(files: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame, old_raw: DataFrame, new_raw: DataFrame, save: Save = kept) -> DataFrame:
    """(tier, file_path) of the other files whose references may resolve otherwise now.

    files: the changed and vanished ones; old_nodes and old_raw: all rows before; new_nodes and new_raw: rows of the
    changed files. What all files have in common with the changed ones is found by joins on these.
    """
    files = files.select(*FILE).distinct()
    before = save(old_nodes.join(files, FILE, "left_semi"))
    rest = old_nodes.join(files, FILE, "left_anti")
    gone_raw, kept_raw = old_raw.join(files, FILE, "left_semi"), old_raw.join(files, FILE, "left_anti")
    of = lambda f, name, rows: rows.select(f(F.col("qualified_name")).alias(name))
    news = lambda f, name: symmetric(of(f, name, before), of(f, name, new_nodes)).join(of(f, name, rest), name, "left_anti")
    targets = save(news(lambda c: c, "target"))
    full = lambda rows: rows.where("kind = 'method'").select(F.col("qualified_name").alias("full"))
    by_method = symmetric(full(before), full(new_nodes)).select(parent(F.col("full")).alias("cls"))
    pairs = [r.where("kind = 'inherits'").select(F.col("src_qname").alias("cls"), F.col("target").alias("base")) for r in (gone_raw, new_raw, kept_raw)]
    by_base = symmetric(*pairs[:2]).select("cls")
    by_name = pairs[2].join(targets.select(F.col("target").alias("base")), "base", "left_semi").select("cls")
    classes = subclasses(by_method.unionByName(by_base).unionByName(by_name), reduce(DataFrame.unionByName, pairs).distinct(), save=save)
    keyed = kept_raw.select(*FILE, "target", top(F.col("target")).alias("top"), parent(F.col("target")).alias("cls"))
    hits = [keyed.join(classes, "cls", "left_semi").select(*FILE)]
    if not targets.isEmpty():  # without a new or lost name there is no new or lost first part
        hits += [keyed.join(keys, key, "left_semi").select(*FILE) for key, keys in (("target", targets), ("top", news(top, "top")))]
    return reduce(DataFrame.unionByName, hits).distinct()


def maintained(files: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame, old_raw: DataFrame, new_raw: DataFrame, save: Save = kept) -> tuple[DataFrame, DataFrame]:
    """(tier, file_path) of other files to resolve again, and the references of these and of the changed files.

    The names, bases and members are those after the change.
    """
    again = save(touched(files, old_nodes, new_nodes, old_raw, new_raw, save))
    nodes = old_nodes.join(files.select(*FILE), FILE, "left_anti").unionByName(new_nodes.select(*old_nodes.columns))
    rest = old_raw.join(files.select(*FILE), FILE, "left_anti")
    raw = rest.unionByName(new_raw.select(*old_raw.columns))
    todo = save(rest.join(again, FILE, "left_semi").unionByName(new_raw.select(*old_raw.columns)))
    return again, resolve(todo, nodes, bases_of(raw, nodes), save)
