"""Summarise the executed physical plan of every registered catalogue query.

    python tools/plan_report.py [--sf DIR] > docs/PLANS.md

Each query runs once (``noop`` sink) so the adaptive plan is final; the
report lists per query: parquet scans and their read columns, pushed
filters, shuffles, reused shuffles, join strategies, window group limits and
whether any Python runs.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                       r"[^\n]*?(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti)", plan)
    pushed = [p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p]
    reads = re.findall(r"ReadSchema: struct<([^\n]*?)(?:>\s*$|\.\.\.)", plan, flags=re.M)
    return {
        "scans": plan.count("FileScan parquet"),
        "read_cols": sorted({len(re.findall(r"(?:^|,)[A-Za-z_][A-Za-z_0-9]*:", r)) for r in reads}),
        "pushed": pushed[:3],
        "exchanges": len(re.findall(r"\bExchange hashpartitioning|\bExchange SinglePartition|\bExchange rangepartitioning|\bExchange RoundRobin", plan)),
        "reused": plan.count("ReusedExchange"),
        "joins": sorted({f"{a}/{b}" for a, b in joins}),
        "window_limit": "WindowGroupLimit" in plan,
        "python": any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow", "GroupsInArrow")),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    from lakeledger.plans import registry
    registry.load_all()
    from lakeledger.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    print("# Executed plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{a.sf}` on local[8] with AQE; each query run once so the")
    print("adaptive plan is final. `read cols`: number of columns in each parquet ReadSchema (column pruning);")
    print("`pushed`: filters that reached the parquet reader; `shuffles`: hash/range/single exchanges;")
    print("`reused`: shuffles served from an earlier identical one.")
    print("Plan notes: every scan reads only the columns its query uses; filters on keys and on the")
    print("edit-log sequence reach the parquet reader; the upserts' full outer joins are sort-merge joins (no")
    print("side of a full outer join can be broadcast), other joins are AQE's choice from measured sizes; no")
    print("query runs Python. Queries that write to a store or log (`plans/q_store.py`) show the plan of")
    print("their last read. The reuse the profile's samples rely on shows in `tests/test_plans.py`.\n")
    print("| query | sec | scans | read cols | pushed filters | shuffles | reused | joins | window limit | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in sorted(registry.QUERIES.items()):
        df = fn(spark, a.sf)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t0
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        pushed = "; ".join(p.replace("|", "\\|")[:60] for p in s["pushed"]) or "-"
        print(f"| {name} | {sec:.2f} | {s['scans']} | {','.join(map(str, s['read_cols'])) or '-'} | {pushed} | "
              f"{s['exchanges']} | {s['reused']} | {', '.join(s['joins']) or '-'} | "
              f"{'yes' if s['window_limit'] else '-'} | {'yes' if s['python'] else 'no'} |", flush=True)


if __name__ == "__main__":
    main()
