"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from scholarlake import catalog

#: One of each kind: scan, search, index, vector, fusion, window, join, profile, expansion, greedy.
HEADLINES = (
    "q1_boolean_search", "q11_relevance_page", "q19_relaxation_counts", "s5_upsert", "f7_bm25", "r1_keyword_route", "w7_exact_nearest", "w1_weighted_rrf",
    "c1_word_chunks", "c9_index_build", "x10_candidate_pool", "j7_lifecycle_stats", "j15_asset_sections", "a1_sessions", "a11_length_stats", "a15_topic_scores",
    "w9_zones", "w6_cluster_recall", "f16_p2_base_scores", "e1_e2_retrieval_metrics", "t4_rate_limit", "x12_budget_selection", "o3_status_case", "c12_table_cells",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up is not a query
    found, queries = {}, catalog.queries()
    for name in HEADLINES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
