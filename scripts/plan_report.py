"""Summarise the physical plan of every registered query into PLANS.md.

    python scripts/plan_report.py [--sf /root/testdata/sf0.01]

Counts, per query, the Parquet scans, shuffles, broadcasts, windows, Python
nodes and any nested-loop or cartesian join in the initial physical plan
(AQE may still turn a shuffle join into a broadcast join at run time).
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "scans": r"FileScan parquet|Scan parquet",
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition",
    "single_partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "windows": r"\bWindow \[",
    "group_limit": r"WindowGroupLimit",
    "python": r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|FlatMapGroupsInArrow",
    "nested_loop_or_cartesian": r"BroadcastNestedLoopJoin|CartesianProduct",
}
SKIP = {"ingest_options", "ingest_price", "ingest_manifest", "ingest_quarantine", "manifest_dedupe", "iv_rank_incremental",
        "stream_silver_merge", "stream_silver_merge_price", "csv_snapshot_sink", "replace_table"}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md"))
    args = ap.parse_args()
    from chainlake.plans.catalog import queries
    from chainlake.session import get_spark

    spark = get_spark()
    rows = []
    for k, fn in sorted(queries().items()):  # core registry only
        if k in SKIP or k.endswith("_sorted") or k.endswith("_one_expiry"):
            continue
        plan = fn(spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        counts = {n: len(re.findall(p, plan)) for n, p in PATTERNS.items()}
        rows.append((k, counts))
    cols = list(PATTERNS)
    lines = ["# Physical plan summary", "",
             f"Generated by `scripts/plan_report.py` at {os.path.basename(args.sf)}; initial physical plans "
             "(AQE re-plans at run time). The ingestion and publish queries, which run streaming or write "
             "jobs while they are built, and the sorted reports, which checkpoint the sort of a query listed "
             "here, are left out.", "",
             "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for k, c in rows:
        lines.append(f"| {k} | " + " | ".join(str(c[n]) for n in cols) + " |")
    tot = {n: sum(c[n] for _, c in rows) for n in cols}
    lines.append("| **total** | " + " | ".join(str(tot[n]) for n in cols) + " |")
    lines += ["", "Reading the table:", "",
              "- `single_partition`: only global aggregates without a grouping key (data-quality "
              "counts, totals). They are combined partially first, so one row per partition crosses.",
              "- `python`: 0 everywhere; no query of the core library uses Python workers.",
              "- `group_limit`: `WindowGroupLimit`, the map-side top-1 Spark plans for `row_number() = 1`; "
              "it appears twice per newest-row selection (before and after the shuffle).",
              "- `nested_loop_or_cartesian` is 0 everywhere: every join has an equi-key."]
    open(args.out, "w").write("\n".join(lines) + "\n")
    print(f"wrote {args.out}: {len(rows)} queries; nested-loop/cartesian: {tot['nested_loop_or_cartesian']}, "
          f"single-partition exchanges: {tot['single_partition']}, python nodes: {tot['python']}")


if __name__ == "__main__":
    main()
