"""Print scale red flags in the physical plan of every registered query.

Flags: single-partition exchanges (global windows/sorts funnelled into one task), cartesian
products, nested-loop joins, and the number of shuffle exchanges.
usage: python tools/plan_audit.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from redline.session import get_spark
    from redline.plans.registry import QUERIES as qs, load_all
    load_all()
    spark = get_spark("local[8]")
    for n in a.names or sorted(qs):
        if n.startswith("stream_") or n in ("read_chat_jsonl", "read_json_examples", "write_training_jsonl", "write_features"):
            continue
        df = qs[n](spark, a.sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        flags = []
        if "SinglePartition" in plan:
            flags.append("SINGLE_PARTITION")
        if "CartesianProduct" in plan:
            flags.append("CARTESIAN")
        if "BroadcastNestedLoopJoin" in plan:
            flags.append("BNLJ")
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))
        print(f"{n:28s} exchanges={ex:2d} {' '.join(flags)}")
    spark.stop()


if __name__ == "__main__":
    main()
