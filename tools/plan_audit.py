"""Print a one-line physical-plan summary per query key: exchanges,
broadcasts, Python operators and the columns / filters each scan reads.

    python tools/plan_audit.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from benchtide.registry import QUERIES  # noqa: E402
from benchtide.session import build_session  # noqa: E402


def summary(plan: str) -> str:
    ex = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan))
    single = len(re.findall(r"Exchange SinglePartition", plan))
    bc = len(re.findall(r"BroadcastExchange", plan))
    py = len(re.findall(r"MapInArrow|ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython|PythonMapInArrow", plan))
    scans = re.findall(r"ReadSchema: (struct<[^,\]]*(?:,[^,\]]*)*>)", plan)
    pushed = [p for p in re.findall(r"PushedFilters: (\[[^\]]*\])", plan) if p != "[]"]
    return (f"exchanges={ex} single_partition={single} broadcasts={bc} python_ops={py} "
            f"scans={[s[:90] for s in scans]} pushed={pushed}")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]", 8)
    for key, fn in QUERIES.items():
        if only and key not in only:
            continue
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"{key:24s} {summary(plan)}")


if __name__ == "__main__":
    main()
