"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) names the tables, ``BENCH_CPUS`` the local cores. Each query
is run to its last row into the no-op sink; building it, driver decisions included, is timed too.
Every query runs twice and the better time counts: the first run also loads and compiles code.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from checks.session import local_session

HEADLINE = (
    "a01_flights_by_direction",
    "p04_route_kpis",
    "r03_recommended",
    "r14_revenue_mix",
    "p06_answers",
    "w02_breakeven_tracker",
    "c02_clean_numeric",
    "c07_conversion_error_report",
    "q01_null_profile",
    "q03_classify_columns",
    "q06_duplicate_stats",
    "q07_drop_duplicates",
    "q08_impute_median_mode",
    "a08_describe_all",
    "o03_outlier_summary_iqr",
    "o05_cap_mad_report",
    "p02_clean_flights",
    "p03_clean_tickets",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("/sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
