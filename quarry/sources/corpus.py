"""File trees as rows, include rules, tiers and their snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lines

#: The directories of a tier's snapshot, in order; other tiers have one of their own name.
TIER_DIRECTORIES = {"pip": ["pip-packages", "apt-packages"]}


def in_excluded_directory(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a directory of the path, at any depth, has one of the names."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lit(list(names)).cast("array<string>")) if names else F.lit(False)


def glob_pattern(glob: str) -> str:
    """A regular expression for whole paths: ** crosses directories, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k]))
            k += 1
    return f"^{out}$"


def is_included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; no include means all."""
    any_of = lambda globs: F.coalesce(path.rlike("|".join(map(glob_pattern, globs))), F.lit(False))
    kept = any_of(include) if include else F.lit(True)
    return kept & ~any_of(exclude) if exclude else kept


def is_safe(path: Column) -> Column:
    """Relative, without a step upwards."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & (path != "")


def tier_locations(tier: Column) -> Column:
    out = F.array(tier)
    for name, directories in TIER_DIRECTORIES.items():
        out = F.when(tier == name, F.lit(directories)).otherwise(out)
    return out


def resolve(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(tier, path, found): for each wanted (tier, path) the first of its tier's locations that has the file."""
    places = wanted.where(is_safe(F.col("path"))).select("tier", "path", F.posexplode(tier_locations(F.col("tier"))).alias("pos", "location"))
    hits = places.join(present, F.concat_ws("/", "location", "path") == F.col("file_path")).groupBy("tier", "path").agg(F.min_by("file_path", "pos").alias("found"))
    return wanted.join(hits, ["tier", "path"], "left")


def corpus_files(files: DataFrame) -> DataFrame:
    """(tier, file_path, size, sha256, sha512, n_lines)."""
    return files.select("tier", "file_path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"), F.size(lines(F.col("content"))).cast("long").alias("n_lines"))
