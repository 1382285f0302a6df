"""Time the headline queries and print one JSON line.

Each query runs from the given tables to a no-op sink that reads every output
column; layers shared by several consumers are written and read back inside the
timed query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "f01_typed_production",
    "f03_dim_well",
    "f06_fact_production",
    "f07_monthly_production",
    "f08_top_wells",
    "f09_production_by_fluid",
    "f10_well_features",
    "f11_training_dataset",
    "f16_decline_fit",
    "f18_backtest_with_decline",
    "f21_multi_cutoff",
    "q09_point_in_time_audit",
    "q12_blocking_gate",
    "r03_latency_percentiles",
)


def main() -> None:
    from wellpanel.plans.catalog import QUERIES
    from wellpanel.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)) if cpus.isdigit() else "16",
        spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths once, so that the first query is not charged for them
    QUERIES["f01_typed_production"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
