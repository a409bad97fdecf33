"""Physical-plan summary of every registered query: shuffles, sorts, joins,
windows, scans (with their read schemas) and subqueries.

Usage: python tools/plan_report.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orrery.plans import catalog  # noqa: E402
from orrery.session import local_session  # noqa: E402


def summary(plan: str) -> dict:
    return {
        "exchange": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "bcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "shj": plan.count("ShuffledHashJoin"),
        "sort": len(re.findall(r"\bSort \[", plan)),
        "window": len(re.findall(r"\bWindow \[", plan)),
        "scans": len(re.findall(r"FileScan parquet", plan)),
        "subq": plan.count("Subquery subquery"),
        "py": int(any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"))),
        "cross": int("CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if "/" not in a]
    catalog.load_all()
    spark = local_session()
    print(f"{'query':28s} exch bcast smj bhj shj sort win scan subq py cross")
    for name, fn in catalog.QUERIES.items():
        if names and name not in names:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summary(plan)
        print(f"{name:28s} {s['exchange']:4d} {s['bcast']:5d} {s['smj']:3d} {s['bhj']:3d} {s['shj']:3d} "
              f"{s['sort']:4d} {s['window']:3d} {s['scans']:4d} {s['subq']:4d} {s['py']:2d} {s['cross']:5d}")
        if names:
            print(plan)


if __name__ == "__main__":
    main(sys.argv)
