"""Exact symbol lookup and file spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.keys import common_tail, module_of
from quarry.functions.text import lines, span, span_error
from quarry.sources.corpus import is_safe

PRIORITY = ["class", "method", "function"]


def get_symbol(chunks: DataFrame, name: str) -> DataFrame:
    """The definition of a name: of an exact identity, else of its last one or two parts in a module that fits.

    Pieces of one definition are joined in order. No row if there is none.
    """
    parts = name.split(".")
    options = [(0, name, None)] + [(n, ".".join(parts[-n:]), ".".join(parts[:-n])) for n in (1, 2) if n < len(parts)]
    rows = chunks.where(F.col("chunk_type").isin(PRIORITY) & F.col("identity").isin([o[1] for o in options]))
    step = F.lit(None).cast("int")
    for n, identity, module in reversed(options):
        fits = F.col("identity") == identity
        if module is not None:
            fits = fits & common_tail(module_of(F.col("file_path")), F.lit(module))
        step = F.when(fits, n).otherwise(step)
    place = F.array_position(F.lit(PRIORITY), F.col("chunk_type"))
    rows = rows.withColumn("_step", step).where("_step is not null").withColumn("_place", place)
    whole = rows.groupBy("tier", "file_path", "chunk_type", "identity", "_step", "_place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub_ordinal", "source_text"))), lambda p: p["source_text"]), "\n").alias("source"),
        F.min("line_start").alias("line_start"),
        F.max("line_end").alias("line_end"),
    )
    return whole.orderBy("_step", "_place", "tier", "file_path").limit(1).select(F.lit(name).alias("qualified_name"), "chunk_type", "tier", "file_path", "line_start", "line_end", "source")


def lookup_names(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, qualified_name, file_path): for many names at once the first node of the best kind, in order of path."""
    place = F.array_position(F.lit(PRIORITY), F.col("kind"))
    rows = wanted.join(nodes.where(F.col("kind").isin(PRIORITY)), F.col("query") == F.substring_index("qualified_name", ".", -1))
    first = Window.partitionBy("query").orderBy(place, "tier", "file_path", "qualified_name")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query", "qualified_name", "file_path")


def read_spans(wanted: DataFrame, files: DataFrame, tiers: list[str]) -> DataFrame:
    """(tier, path, line_start, line_end, text, error_kind) for each wanted (tier, path, line_start, line_end)."""
    content = files.select("tier", F.col("file_path").alias("path"), F.col("content").alias("_c"), F.lit(True).alias("_there"))
    rows = wanted.join(content, ["tier", "path"], "left").withColumn("_l", lines(F.col("_c")))
    first, last = F.coalesce("line_start", F.lit(1)), F.coalesce("line_end", F.size("_l"))
    kind = (
        F.when(~F.col("tier").isin(tiers), "unknown_tier")
        .when(~is_safe(F.col("path")), "outside")
        .when(F.col("_there").isNull(), "missing")
        .when(span_error(F.col("_l"), first, last).isNotNull(), "bad_range")
    )
    rows = rows.withColumn("error_kind", kind).withColumn("_first", first).withColumn("_last", last)
    good = F.col("error_kind").isNull()
    return rows.select(
        "tier", "path",
        F.when(good, F.col("_first")).alias("line_start"),
        F.when(good, F.least("_last", F.size("_l"))).alias("line_end"),
        F.when(good, span(F.col("_l"), F.greatest(F.lit(1), F.col("_first")), F.col("_last"))).alias("text"),
        "error_kind",
    )
