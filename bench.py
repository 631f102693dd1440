"""Seconds of the headline queries, as one JSON line: each is run once to warm up, then the median of BENCH_RUNS (3) counts."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from allotau.plans import queries as own

HEADLINE = ["fit_params", "curve_sample", "fit_overlay", "quasi_dynamic_order", "minmax_0_1", "minmax_neg1_1", "log1p_transform", "row_total", "loglog_points", "fit_point_stats", "fit_params_log1p", "fit_unfiltered", "chebyshev_nodes"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            own.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm, median", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "spark": spark.version, "shuffle_partitions": cpus, "driver_memory": "8g"}))
    spark.stop()


if __name__ == "__main__":
    main()
