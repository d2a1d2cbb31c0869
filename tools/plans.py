"""Summarise the physical plan of every registered query (PLANS.md).

For each query: shuffles (Exchange other than broadcast), broadcasts,
sort-merge / broadcast-hash joins, windows, aggregates, generators, and the
scans' ReadSchema.  Plans are taken before execution (AQE may still turn a
shuffled join into a broadcast join at run time).  Of queries that write files
or run jobs while being built (sources, training, streaming), the plan is that of
what they return.
Usage: python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clauselake.plans.queries import queries  # noqa: E402
from clauselake.session import local_session  # noqa: E402

def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python tools/plans.py {sf}`; counts are plan nodes before adaptive execution.\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | windows | aggregates | generators | scans (columns read) |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in queries().items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))
        bcast = plan.count("BroadcastExchange")
        smj = plan.count("SortMergeJoin")
        bhj = plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")
        win = len(re.findall(r"\bWindow(GroupLimit)? \[", plan)) + len(re.findall(r"\bWindow ", plan))
        agg = plan.count("HashAggregate(") + plan.count("ObjectHashAggregate(") + plan.count("SortAggregate(")
        gen = len(re.findall(r"\bGenerate ", plan))
        scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*?Location: [^\[\n]*\[[^\]\n]*/(\w+)\.parquet", plan)
        scan_txt = "; ".join(f"{t}({len(cols.split(','))})" for cols, t in scans)
        print(f"| {name} | {shuffles} | {bcast} | {smj} | {bhj} | {win} | {agg} | {gen} | {scan_txt} |")


if __name__ == "__main__":
    main()
