"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS (timed runs after one warm-up; the median counts) and BENCH_QUERIES
(comma-separated names) override the defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g1_type_counts", "g2e_report_page_rollup", "g3e_page_tables", "g4e_unused_tables", "g5_lineage", "g6e_full_chain",
    "g2_report_page_rollup", "g6_full_chain", "profile_columns", "profile_sample", "code_refs", "dataflow_refs", "activity_order", "layer_transitions", "edges_gold",
    "edges_silver", "measure_deps", "page_tables", "edge_groups", "relationships",
]


def main() -> None:
    from catloom.session import build_session
    from checks.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
