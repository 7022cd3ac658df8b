"""Headline timings: prints one JSON line. Each query runs once to warm up, then the median of BENCH_REPEATS (2) runs counts."""

from __future__ import annotations

import json
import os
import statistics
import time

from cotejo.catalog import registry
from cotejo.session import local_session

HEADLINE = (
    "v7_fallback", "v9_positional_ensemble", "v9_digit_ensemble", "g1_dedupe_best", "j1_whole_id_consensus",
    "j7_same_row_names", "g6_assemble_rows_a", "a5_cluster_words", "j6_pair_by_proximity", "j12_authorize_requests",
    "j13_validate_rows", "g15_usage_counters", "g17_build_invoices", "j3_pair_readings", "j5_match_pairs", "v8_vote_pairs",
)


def seconds(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "cotejo-bench")
    queries = registry()
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    times = {}
    for name in HEADLINE:
        run = queries[name][0]
        seconds(run, spark, sf_dir)
        times[name] = round(statistics.median(seconds(run, spark, sf_dir) for _ in range(repeats)), 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "form_rows": rows,
        "form_rows_per_sec": {k: round(rows / times[k]) for k in ("v7_fallback", "v9_digit_ensemble", "j7_same_row_names")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
