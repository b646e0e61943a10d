"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion into Spark's ``noop`` sink (every row is
produced, nothing is collected to the driver).  The first round is cold
(JVM warm-up, code generation); the reported time per query is the best of
the warm rounds.  Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "silver_options", "silver_price", "latest_snapshot", "pcr_all", "iv_rank", "greeks_exposure",
    "greeks", "hv", "chain_filter", "term_structure", "gex_by_strike", "ohlc", "ema", "oi_change",
    "contract_summary", "dq_silver_options", "iv_moments", "box_plot", "qq_fit", "kde", "welch_ttest_p",
]
# Timed as well, but not part of the headline total, which stays comparable
# from round to round.
HEAVY = ["dq_silver_price", "iv_change_prev", "ingest_options", "stream_silver_merge"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or HEADLINE

    from chainlake.plans.catalog import queries
    from chainlake.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = queries()
    cold, warm = {}, {}
    for k in [*keys, *(HEAVY if keys is HEADLINE else [])]:
        times = []
        for _ in range(1 + rounds):
            t0 = time.perf_counter()
            qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        cold[k] = round(times[0], 3)
        warm[k] = round(min(times[1:]) if rounds else times[0], 3)
    heavy = {k: warm.pop(k) for k in HEAVY if k in warm and k not in keys}
    cold = {k: v for k, v in cold.items() if k in keys}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total_warm", "value": round(sum(warm.values()), 3),
           "unit": "sec", "queries": warm, "heavy": heavy, "cold": cold, "cold_total": round(sum(cold.values()), 3),
           "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
