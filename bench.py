"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local core count. Every query
runs to its last row into a sink that discards them; the session is warmed up once before.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from cellweek.catalog.queries import QUERIES  # noqa: E402

HEADLINE = [
    "clean_incidents",
    "csv_parquet_roundtrip",
    "holiday_flag",
    "grid_hotspots",
    "grid_hotspot_summary",
    "top_hotspots",
    "hotspot_incidents",
    "weekly_series",
    "seasonal_features",
    "fit_seasonal",
    "forecast_weeks",
    "forecast_report",
    "knn_kdist",
    "density_levels",
    "dbscan_labels",
    "cluster_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cellweek-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["weekly_series"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = folder.rsplit("sf", 1)[-1]
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
