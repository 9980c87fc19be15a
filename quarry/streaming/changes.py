"""File changes: translated, debounced and applied, as a batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE = "1500 milliseconds"


def operations(events: DataFrame) -> DataFrame:
    """(tier, file_path, op, ts, seq) of events (tier, event, src, dest, ts, seq): a move is a purge and an index."""
    one = lambda path, op: F.struct(F.col(path).alias("file_path"), F.lit(op).alias("op"))
    ops = (
        F.when(F.col("event") == "moved", F.array(one("src", "purge"), one("dest", "index")))
        .when(F.col("event") == "deleted", F.array(one("src", "purge")))
        .when(F.col("event").isin("created", "modified"), F.array(one("src", "index")))
    )
    return events.select("tier", F.explode(ops).alias("o"), "ts", "seq").select("tier", "o.file_path", "o.op", "ts", "seq")


def debounced(ops: DataFrame, quiet: str = DEBOUNCE) -> DataFrame:
    """(tier, file_path, started, ended, op, n): bursts without a pause of ``quiet``; the last operation wins.

    On a stream, give the operations a watermark: a burst comes out once the watermark has passed its end, and what is
    later is a burst of its own, which is safe as operations are idempotent.
    """
    rows = ops.groupBy("tier", "file_path", F.session_window("ts", quiet).alias("w"))
    out = rows.agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.count("*").alias("n"))
    return out.select("tier", "file_path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "op", "n")


def final_operations(ops: DataFrame) -> DataFrame:
    """(tier, file_path, op): what is left to do for each file, by its last operation."""
    return ops.groupBy("tier", "file_path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))


def checked_against(ops: DataFrame, listing: DataFrame) -> DataFrame:
    """An index operation for a file that is gone is a purge."""
    there = listing.select("tier", "file_path", F.lit(True).alias("_there"))
    rows = ops.join(there, ["tier", "file_path"], "left")
    return rows.withColumn("op", F.when(F.col("_there").isNull(), "purge").otherwise(F.col("op"))).drop("_there")


def run(ops: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 seconds", quiet: str | None = DEBOUNCE, every: str | None = None) -> StreamingQuery:
    """Applies bursts of a stream of operations to the index, one micro-batch after the other.

    quiet: None passes on each micro-batch as it is, for sources that have put together what belongs together. every: the
    trigger's interval; None takes all that is there now, and ends.
    """
    bursts = debounced(ops.withWatermark("ts", late), quiet) if quiet else ops
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return bursts.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()
