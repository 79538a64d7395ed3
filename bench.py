"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once unrecorded, then RUNS times; its figure is the median of those, from reading the text to the last
row, written nowhere. Amounts are doubles, as in the data.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = 3
HEADLINE = ["q1", "q3", "q6", "q8", "q9", "q10", "q18", "cumulate", "pairwise_of_cumulate", "hotspot", "join_anti", "join_left", "join_range", "join_residual", "union_distinct", "having"]


def main() -> None:
    from pyspark.sql import SparkSession

    from quillon.queries import PLANS, run

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}
    for name in HEADLINE:
        query, times = run(PLANS[name], exact=False), []
        for i in range(RUNS + 1):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
