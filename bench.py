"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidemark.plans.registry import QUERIES

AT = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = ["quality_buckets", "samples_trim", "cache_health", "score_streams", "rank_quality", "run_activity", "runs_collapsed", "epg_current", "plan_jobs", "compose_assign", "provider_bitrate_median", "quality_effects", "normalize_names", "match_contains", "match_regex", "match_best_step", "stream_search", "provider_verdict_age"]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, AT).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, median of three after a warm-up", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": AT.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
