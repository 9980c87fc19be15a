"""Durable notes: saved once, restored from the ledger, recalled by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.keys import memory_id, parsed_stamp, refs_stamp
from quarry.functions.vectors import hash_embedding
from quarry.operators.search import batch_top_k


def saved(notes: DataFrame) -> DataFrame:
    """The ledger rows of notes (text, refs, metadata, seq): one for each text and references, the latest metadata."""
    rows = notes.withColumn("refs_stamp", refs_stamp(F.col("refs"))).withColumn("memory_id", memory_id(F.col("text"), F.col("refs_stamp")))
    return rows.groupBy("memory_id").agg(F.first("text").alias("text"), F.first("refs_stamp").alias("refs_stamp"), F.max_by("metadata", "seq").alias("metadata"))


def merged(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of equal id."""
    return ledger.join(new.select("memory_id"), "memory_id", "left_anti").unionByName(new.select(*ledger.columns))


def missing(ledger: DataFrame, points: DataFrame) -> DataFrame:
    """Ledger rows whose point is gone: what a restore embeds again."""
    return ledger.join(points.select("memory_id"), "memory_id", "left_anti")


def backfilled(ledger: DataFrame, points: DataFrame) -> DataFrame:
    """Points that the ledger doesn't know become ledger rows; rows there stay."""
    rows = points.join(ledger.select("memory_id"), "memory_id", "left_anti")
    return ledger.unionByName(rows.select("memory_id", F.col("note_text").alias("text"), refs_stamp(F.col("refs")).alias("refs_stamp"), F.lit("{}").alias("metadata")))


def embedded(ledger: DataFrame, dim: int) -> DataFrame:
    """Points of notes with hash vectors."""
    return as_points(ledger).withColumn("vector", hash_embedding(F.col("note_text"), dim))


def as_points(ledger: DataFrame) -> DataFrame:
    return ledger.select("memory_id", F.col("text").alias("note_text"), parsed_stamp(F.col("refs_stamp")).alias("refs"))


def recall(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest notes of each query (query_id, v)."""
    return batch_top_k(points, queries, k, key="memory_id")
