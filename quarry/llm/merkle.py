"""A Merkle manifest of documents: trees of 16 children, one per source and one over the sources, with proofs for all rows.

A leaf is the hash of a row's five fields. Its place in its source comes from a sort by ranges, so one source spreads over
many tasks; nodes are numbered by place, and a parent is a group of at most 16 nodes. For each parent its preimage, the
hashes of its children one after the other, is stored. A leaf joins its ancestors' preimages: these are first handed down
from the root to the parents of leaves, a sixteenth of the rows, so the leaves join once. A proof is what is left of the
preimages when the own slot of 64 characters is cut out of each; a changed leaf is folded to a root by putting its hash
in the slot, hashing, and going on with the next preimage.

Null fields are hashed as ``-``. Rows without doc_id come first in their source and are never tampered with; rows of one
doc_id are in order of their leaf, and rows that agree in all five fields, which no order tells apart, each have a place.
Rows without source are a source of their own, before all others. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, crc_of_id, documents, shuffle_partitions

FAN, WIDTH = 16, 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """The UTF-8 byte count of a value, a colon and the value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the changed row's leaf, null for rows that stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in FIELDS[1:]))
    changed = F.when(crc_of_id() % 5 == 0, leaf_of(text=F.translate("text", UPPER, LOWER)))
    return rows.select("doc_id", F.col("source").cast("string").alias("source"), leaf_of().alias("leaf"), changed.alias("tampered"))


def placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """The rows (src and more) with ``place``, from 0 in each src in the given order, and ``n``, the rows of the src.

    Ranges of rows are numbered on their own; a range's offset in a src is the number of its rows in ranges before. Rows
    that agree in src and order may fall into several ranges, as the number of the row is the last key.
    """
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "src", *order, "_row").withColumn("_range", F.spark_partition_id())
    ranged = scratch.save(ranged)
    counts = ranged.groupBy("src", "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("src")  # a row for each range that the src is in
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("src", "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("_range", "src").orderBy(*order, "_row")) - 1
    numbered = ranged.withColumn("_k", place).join(counts, ["_range", "src"])
    return scratch.save(numbered.withColumn("place", F.col("_k") + F.col("_before")).drop("_k", "_before", "_row", "_range"))


def tree(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Levels of parents (src, place, n, preimage), the lowest first, and the tops (src, node), of (src, place, n, node)."""
    levels, tops, left = [], [], nodes.select("src", "place", "n", "node")
    while True:
        tops.append(left.where("n = 1").select("src", "node"))
        parent = [F.floor(F.col("place") / FAN).cast("long").alias("place"), F.ceil(F.col("n") / FAN).cast("long").alias("n")]
        run = F.array_sort(F.collect_list(F.struct("place", "node")))  # 16 nodes at most
        parents = left.where("n > 1").groupBy("src", *parent).agg(F.array_join(F.transform(run, lambda x: x["node"]), "").alias("preimage"))
        left = scratch.save(parents.withColumn("node", F.sha2("preimage", 256)))
        if left.isEmpty():
            return levels, reduce(DataFrame.unionByName, tops)
        levels.append(left.drop("node"))


def with_path(children: DataFrame, parents: DataFrame | None, above: DataFrame) -> DataFrame:
    """The children with what hangs on them: ``path``, a (preimage, slot) for each ancestor, the nearest first, and subroot.

    parents: (src, place, preimage, path, subroot), none if no child has one. The top of a src has what ``above`` (src,
    path, subroot) says.
    """
    out = children.where("n = 1").join(above, "src")
    if parents is None:
        return out
    up = parents.select("src", F.col("place").alias("_up"), "preimage", F.col("path").alias("_path"), "subroot")
    up = up.withColumnRenamed("preimage", "_preimage")
    own = F.array(F.struct(F.col("_preimage").alias("preimage"), (F.col("place") % FAN).cast("int").alias("slot")))
    rows = children.where("n > 1").withColumn("_up", F.floor(F.col("place") / FAN).cast("long")).join(up, ["src", "_up"])
    return out.unionByName(rows.withColumn("path", F.concat(own, "_path")).select(*out.columns))


def with_paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """The paths go down from level to level, each a sixteenth of the next; the nodes join once."""
    parents = None
    for level in reversed(levels):
        parents = scratch.save(with_path(level, parents, above))
    return with_path(nodes, parents, above)


def excised(step: Column) -> tuple[Column, Column]:
    """What lies before and after the own slot in a preimage."""
    at = step["slot"] * WIDTH
    return F.substr(step["preimage"], F.lit(1), at), F.substr(step["preimage"], at + WIDTH + 1)


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.concat(*excised(x))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""

    def up(node: Column, step: Column) -> Column:
        left, right = excised(step)
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, proof_sha256, folded_root, verified), a row for each row of ``docs``.

    siblings: the digests that prove the leaf, one after the other, level by level up to the root.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    # a key that sorts as the source does, null first
    rows = leaves(docs).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).withColumnRenamed("leaf", "node")
    rows = placed(rows.select("src", "doc_id", "node", "tampered"), ["doc_id", "node"], scratch)
    levels, tops = tree(rows, scratch)
    tops = tops.select(F.lit("").alias("src"), F.col("src").alias("name"), "node")
    tops = placed(tops, ["name"], scratch)
    top_levels, root = tree(tops, scratch)
    found = root.first()
    root = F.lit(found["node"] if found else None).cast("string")
    nothing = F.array().cast("array<struct<preimage:string,slot:int>>")
    crown = docs.sparkSession.createDataFrame([("",)], "src string").select("src", nothing.alias("path"), F.lit("").alias("subroot"))
    above = with_paths(tops, top_levels, crown, scratch)
    above = scratch.save(above.select(F.col("name").alias("src"), "path", F.col("node").alias("subroot")))
    out = with_paths(rows, levels, above, scratch)
    end = folded(F.coalesce("tampered", "node"), F.col("path"))
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), siblings(F.col("path")).alias("siblings"), end.alias("folded_root"))
    return out.select("doc_id", "leaf", "subroot", "root", "siblings", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir)).drop("siblings")
