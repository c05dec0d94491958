"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 3: the median of up to three runs after one warm-up), BENCH_BUDGET (default 5: seconds after
which a query is not repeated), BENCH_QUERIES (comma-separated subset).
Every query is run to completion; its rows go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pactline.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "contract_check_summary",
    "validate_events",
    "contract_outcomes_rows",
    "masking_totals",
    "scan_pii",
    "value_masks",
    "detect_pii",
    "parse_envelope",
    "extract_fields",
    "active_version",
    "latest_version",
    "activate_version",
    "history_changes",
    "gate_decisions",
    "gate_consumers",
    "run_events",
    "run_events_by_type",
    "column_lineage",
    "schema_drift",
    "upsert_edges",
    "bfs_reachable",
    "blast_radius_report",
    "histogram",
    "quality_rules",
    "violation_rate",
    "stream_validate",
    "stream_lineage",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "5"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("bench", cpus)
    seconds, repeats = {}, {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        timed: list[float] = []
        while not timed or (len(timed) < runs and sum(timed) < budget):
            timed.append(run(QUERIES[name], spark, sf_dir))
        seconds[name] = round(statistics.median(timed), 3)
        repeats[name] = len(timed)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds_of_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "runs": repeats,
    }))


if __name__ == "__main__":
    main()
