"""Times of the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalog

QUERIES = ["bars_hour", "bars_day", "windows_all", "ewm_family", "backtest_equity", "backtest_metrics", "paths_stationary", "sharpe_interval", "monte_carlo", "parameter_search", "backtest_search"]
#: A fixed amount of work that no code here has a part in: how fast the machine is just now.
PROBE = "sum(hash(id, id * 7) % 1000)"
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    began = time.perf_counter()
    spark.range(0, 400_000_000, 1, int(cpus)).selectExpr(PROBE).collect()
    probe = round(time.perf_counter() - began, 3)
    times = {}
    for name in QUERIES:
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "sum of median seconds by query", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "repeats": REPEATS, "probe_sec": probe}))
    spark.stop()


if __name__ == "__main__":
    main()
