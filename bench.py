"""Time the headline queries; prints one JSON line.

Every query's whole result is written to Spark's no-op sink, after a warm-up of the session on the smallest table.
"""

from __future__ import annotations

import importlib.util
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "search_documents", "filter_keyword", "filter_labels", "table_view", "label_facets", "papers_by_category", "folder_counts", "classification_projection",
    "latest_run_per_model", "provider_accuracy", "class_metrics", "confusion_matrix", "multilabel_metrics", "scan_routes", "flag_upserts", "first_spelling",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="lectern-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/checkpoint")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lectern.queries import QUERIES

    queries = {name: QUERIES[name] for name in HEADLINE}
    if importlib.util.find_spec("lectern.llm") is not None:
        from lectern.llm.registry import QUERIES as LLM

        queries |= LLM
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name, f in queries.items():
        start = time.perf_counter()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
