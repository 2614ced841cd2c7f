"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8). Each query runs
once, to the end, into a sink that drops the rows. `index_build` is the time to cut, count, embed and write both stores;
the search queries after it use those stores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

QUERIES = (
    "path_layers", "index_filter", "code_tokens", "code_keywords", "window_chunks", "file_chunks", "bm25_topk", "bm25_statistics",
    "dense_topk", "exact_topk", "keyword_matches", "index_build", "fused_ranks", "hybrid_search", "hybrid_search_without_model",
    "signal_lookup", "refreshed_chunks", "snapshot_changes", "consensus", "specialist_routing", "committed_diagnoses",
    "applied_diffs", "diff_problems", "test_consistency", "evaluation_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        # Small shuffles with costly expressions behind them: keep them spread over the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from sparkseek import workload
    from sparkseek.workload.retrieval import search_over_tree

    known = workload.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in QUERIES:
        start = time.perf_counter()
        if name == "index_build":
            search_over_tree(spark, folder)
        else:
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else folder,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
