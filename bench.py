"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_files", "line_windows", "chunk_points", "records", "token_counts", "vector_topk", "batch_topk", "mean_pool", "search_pipeline",
    "manifest_diff", "apply_batch", "expected_vs_live", "references", "dead_code", "blast_radius", "memory_save", "debounce_ops", "redact", "document_chunks",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from quarry.plans import catalogue

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the second run is without compilation
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
