"""The per-file ledger: what to index, to purge, to retry; roll-ups and divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["tier", "file_path"]


def needs_reindex(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """The listing with ``action``: new, changed (state, time or size), unchanged. One join on the file's key."""
    known = ledger.select(*KEY, F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"), "state")
    changed = ~F.col("mtime_ns").eqNullSafe(F.col("_m")) | ~F.col("size").eqNullSafe(F.col("_s")) | ~F.col("state").eqNullSafe(F.lit("indexed"))
    return listing.join(known, KEY, "left").withColumn("action", F.when(F.col("state").isNull(), "new").when(changed, "changed").otherwise("unchanged")).drop("_m", "_s", "state")


def vanished(listing: DataFrame, ledger: DataFrame, live_tiers: list[str] | None = None) -> DataFrame:
    """Ledger rows of live tiers whose file is gone."""
    rows = ledger.where(F.col("tier").isin(live_tiers)) if live_tiers is not None else ledger
    return rows.join(listing.select(*KEY), KEY, "left_anti")


def diff(listing: DataFrame, ledger: DataFrame, live_tiers: list[str] | None = None) -> DataFrame:
    """(tier, file_path, action): the sweep's whole plan, with purge for what vanished."""
    todo = needs_reindex(listing, ledger).select(*KEY, "action")
    return todo.unionByName(vanished(listing, ledger, live_tiers).select(*KEY, F.lit("purge").alias("action")))


def outcome_rows(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger rows of a batch of (tier, file_path, sha, mtime_ns, size, ok, chunk_ids).

    A failed file keeps its former chunks but has the new sha, time and size, and state failed.
    """
    old = ledger.select(*KEY, F.col("chunk_ids").alias("_ids"))
    new = outcomes.join(old, KEY, "left")
    ids = F.when(F.col("ok"), F.col("chunk_ids")).otherwise(F.coalesce("_ids", F.array().cast("array<string>")))
    return new.select(*KEY, "sha", "mtime_ns", "size", F.size(ids).alias("n_chunks"), ids.alias("chunk_ids"), F.when(F.col("ok"), "indexed").otherwise("failed").alias("state"))


def apply_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after a batch."""
    new = outcome_rows(ledger, outcomes)
    return ledger.select(*new.columns).join(outcomes.select(*KEY), KEY, "left_anti").unionByName(new)


def skipped_by_hash(outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Outcomes whose content the ledger has indexed already: nothing is embedded for them."""
    known = ledger.where("state = 'indexed'").select(*KEY, F.col("sha").alias("_sha"))
    return outcomes.join(known, KEY).where("sha = _sha").drop("_sha")


def stale_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tier, file_path, point_id): ids of re-indexed files that the new version no longer has."""
    rows = before.join(after.select(*KEY, F.col("chunk_ids").alias("_new")), KEY)
    return rows.select(*KEY, F.explode(F.array_except("chunk_ids", "_new")).alias("point_id"))


def status(ledger: DataFrame) -> DataFrame:
    """One row: files by state, and the chunks that the indexed ones should have."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return ledger.agg(count("indexed"), count("dirty"), count("embedding"), count("failed"), F.coalesce(F.sum(F.when(F.col("state") == "indexed", F.col("n_chunks"))), F.lit(0)).cast("long").alias("expected_chunks"))


def expected_chunks(ledger: DataFrame) -> DataFrame:
    """(tier, expected): chunks of indexed files."""
    return ledger.groupBy("tier").agg(F.coalesce(F.sum(F.when(F.col("state") == "indexed", F.col("n_chunks"))), F.lit(0)).cast("long").alias("expected"))


def indexed_files(ledger: DataFrame) -> DataFrame:
    """(tier, suffix, n): how many files are indexed, by tier and suffix; a file without one has an empty suffix."""
    suffix = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    return ledger.where("state = 'indexed'").groupBy("tier", suffix.alias("suffix")).agg(F.count("*").alias("n"))


def outcome_summary(listing: DataFrame, ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(tier, indexed, failed, skipped, purged): what a sweep's plan and its outcomes (tier, file_path, ok) come to."""
    plan = diff(listing, ledger).join(outcomes.select(*KEY, "ok"), KEY, "left")
    done = F.col("action").isin("new", "changed")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return plan.groupBy("tier").agg(count(done & F.col("ok"), "indexed"), count(done & ~F.col("ok"), "failed"), count(F.col("action") == "unchanged", "skipped"), count(F.col("action") == "purge", "purged"))


def divergence(ledger: DataFrame, points: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(tier, expected, live, action): purge_and_reset where counts differ, rebuild_graph where the graph is empty."""
    live = points.groupBy("tier").agg(F.count("*").alias("live"))
    out = expected_chunks(ledger).join(live, "tier", "full_outer").select("tier", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("live", F.lit(0)).alias("live"))
    action = F.when(F.col("expected") != F.col("live"), "purge_and_reset")
    if nodes is not None:
        python = ledger.where("state = 'indexed'").where(F.col("file_path").endswith(".py")).select("tier").distinct().withColumn("_py", F.lit(True))
        graph = nodes.select("tier").distinct().withColumn("_graph", F.lit(True))
        out = out.join(python, "tier", "left").join(graph, "tier", "left")
        action = action.when(F.col("_py") & F.col("_graph").isNull(), "rebuild_graph")
    return out.withColumn("action", action.otherwise("none")).drop("_py", "_graph")


def reset(ledger: DataFrame, tiers: list[str]) -> DataFrame:
    return ledger.withColumn("state", F.when(F.col("tier").isin(tiers), "dirty").otherwise(F.col("state")))


def flag_stale(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """``stale``: the file has a ledger row that isn't indexed; without a row a hit is fresh."""
    rows = ledger.select(*KEY, F.col("state").alias("_state"))
    return hits.join(rows, KEY, "left").withColumn("stale", F.coalesce(F.col("_state") != "indexed", F.lit(False))).drop("_state")
