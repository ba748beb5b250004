"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs
per query (the median counts; one more run warms up).
"""

from __future__ import annotations

import json
import os
import statistics
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "reconciled_union", "exact_duplicates", "market_group", "slips", "leg_attribution",
    "headline_totals", "phase_stats", "market_group_stats", "selection_stats", "proxy_clv",
    "customer_stats", "market_focus_hhi", "watchlist", "anomalies", "customer_gini", "daily_flow",
    "filter_by_legs", "time_series", "fixture_table", "concentrate_leg", "lorenz", "drill_rows",
    "star_export_dims", "star_export_facts",
]


def main() -> None:
    from slipstream.plans.catalog import Run, run_query
    from slipstream.session import local_session

    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        run_query(name, spark, SF_DIR, run).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    start = time.perf_counter()
    run = Run(spark, SF_DIR)  # the queries share its tables
    made = run.tables
    made.all_slips, made.legs, made.plain_legs  # each is written when first read
    seconds = {"build_tables": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(RUNS)), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
