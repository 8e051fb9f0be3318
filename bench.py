"""Benchmark the headline queries.

Runs each query key at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one cold run, then ``$BENCH_WARM`` warm runs; the
median warm time is reported.  Each run executes the whole plan into Spark's
``noop`` sink (no collect to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from benchtide.registry import QUERIES  # noqa: E402
from benchtide.session import build_session  # noqa: E402

HEADLINE = [
    "indexed_series",
    "ordinal_domains",
    "unpivot_timings",
    "build_results_series",
    "state_fold",
    "publish_requests",
    "dispatch_latest",
    "latest_per_key",
    "phase_durations",
    "payload_verdict",
    "admission_status",
    "json_extract",
    "record_decode",
    "intake_dispatch",
    "log_lines",
    "changed_assets",
    "b64",
    "state_fold_stream",
]


def run_once(spark, key, sf_dir) -> float:
    t0 = time.perf_counter()
    df = QUERIES[key](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    warm = int(os.environ.get("BENCH_WARM", "3"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = build_session(f"local[{cpus}]", shuffle, app_name="benchtide-bench")
    per_query, cold = {}, {}
    for key in keys:
        cold[key] = round(run_once(spark, key, sf_dir), 3)
        times = [run_once(spark, key, sf_dir) for _ in range(warm)]
        per_query[key] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_warm_query_seconds",
        "value": round(sum(per_query.values()), 3),
        "unit": "sec",
        "queries": per_query,
        "cold": cold,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "config": {"master": f"local[{cpus}]", "shuffle_partitions": shuffle, "warm_runs": warm,
                   "spark": pyspark.__version__, "python": platform.python_version()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
