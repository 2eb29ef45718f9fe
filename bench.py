"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query: one warm-up run, then the median of 3 timed runs.  A run
executes the whole plan with the ``noop`` sink (nothing is collected to
the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "per_asset_chain", "chain_all", "json_readings", "changes_only", "sampled", "latest_n",
    "doc_filter_tier2", "shell_enriched", "link_unlink", "change_log_conflicts", "elements_flat",
    "asset_flags", "node_browse", "node_snapshot", "deploy_ready", "tool_runs", "gating_audit",
    "rpc_pairs", "search_topk", "page_text", "transcripts", "tcp_lines", "stream_chain",
    "clarify_top3", "change_log_state", "export_documents", "tool_budget", "elements_deep", "review_intake",
    "stream_changes", "stream_sampled", "stream_sink",
]


def run_once(fn, spark, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from sensorloom.plans.catalog import QUERIES
    from sensorloom.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    results = {}
    for n in names:
        fn = QUERIES[n]
        run_once(fn, spark, sf_dir)
        results[n] = round(statistics.median(run_once(fn, spark, sf_dir) for _ in range(3)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": cpus,
                      "config": {"shuffle_partitions": cpus * 2, "aqe": True, "runs": "1 warm-up + median of 3"}}))


if __name__ == "__main__":
    main()
