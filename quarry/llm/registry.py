"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import embedding_dedup, filter_audit, fingerprints, impact_index, language_id, license_scan, merkle, mixing, oracles, packing, pii, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_substrings": substrings.query,
    "op2_mixing": mixing.query,
    "op4_pii": pii.query,
    "op6_toxicity": toxicity.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op1_fingerprints": fingerprints.query,
    "op5_language_id": language_id.query,
    "op7_packing": packing.query,
    "op8_simhash": simhash.query,
    "op9_license_scan": license_scan.query,
    "op11_filter_audit": filter_audit.query,
    "op12_merkle": merkle.query,
    "op13_top_k": impact_index.query,
}

SQL: dict[str, str] = {
    "op2_mixing": oracles.MIXING,
    "op3_substrings": oracles.SUBSTRINGS,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op12_merkle": oracles.MANIFEST,
    "op13_top_k": oracles.TOP_K,
}
