"""Answers from the stored results: the hotspot list, single forecasts and request batches.

spark-submit cellweek/plans/serve.py <result folder> <requests parquet> <output folder> [grid|cluster]

Requests hold request_id, the key columns of the models, start_date and end_date. The output
holds the hotspot list, the reports and the status of every request.
"""

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweek.functions.scalars import combined_id
from cellweek.operators.grid import hotspot_summary
from cellweek.operators.requests import as_json, forecast_reports, request_forecasts, resolve_ids
from cellweek.plans.session import job_session
from cellweek.schema import CELL_SIZE, SEASON_CLUSTER, SEASON_GRID
from cellweek.sources.incidents import models_with_id, publish_table, read_table


def hotspot_list(spark: SparkSession, folder: str, size: float = CELL_SIZE) -> DataFrame:
    """id, centroid and crime_count of the stored grid hotspots."""
    stored = read_table(spark, f"{folder}/hotspot_definitions")
    return hotspot_summary(stored, size).select("id", "centroid", "crime_count")


def cluster_list(spark: SparkSession, folder: str) -> DataFrame:
    """The stored cluster hotspots with their points in pages."""
    return read_table(spark, f"{folder}/hotspots")


def answer(
    spark: SparkSession,
    folder: str,
    asked: DataFrame,
    keys: list[str],
    id_column: str,
    season: int = SEASON_GRID,
    today: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reports of the valid requests, status and code of all requests)."""
    models = read_table(spark, f"{folder}/models")
    if id_column not in [*asked.columns, *keys]:
        asked = asked.withColumn(id_column, combined_id(*keys))
    sliced = request_forecasts(asked, models, keys, season, today)
    return forecast_reports(sliced, id_column), sliced.select("request_id", *keys, "status", "code")


def forecast(
    spark: SparkSession,
    folder: str,
    hotspot: int,
    start_date: str | None = None,
    end_date: str | None = None,
    season: int = SEASON_GRID,
    today: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Report and status of each cell of the grid results that has the asked short id."""
    models = read_table(spark, f"{folder}/models")
    keys = ["hotspot_id_x", "hotspot_id_y"]
    asked = spark.range(1).select(
        F.lit(1).alias("request_id"),
        F.lit(int(hotspot)).cast("bigint").alias("hotspot_id_combined"),
        F.lit(start_date).cast("date").alias("start_date"),
        F.lit(end_date).cast("date").alias("end_date"),
    )
    chosen = models_with_id(models, int(hotspot))
    named = resolve_ids(asked, chosen, keys, "hotspot_id_combined")
    sliced = request_forecasts(named, chosen, keys, season, today)
    return forecast_reports(sliced, "hotspot_id_combined"), sliced.select("request_id", *keys, "status", "code")


def run(spark: SparkSession, folder: str, asked: str, target: str, kind: str = "grid") -> None:
    """Writes hotspots, reports and statuses of the grid or the cluster results."""
    listed, keys, id_column, season = {
        "grid": (hotspot_list, ["hotspot_id_x", "hotspot_id_y"], "hotspot_id_combined", SEASON_GRID),
        "cluster": (cluster_list, ["hotspot_id"], "hotspot_id", SEASON_CLUSTER),
    }[kind]
    reports, statuses = answer(spark, folder, read_table(spark, asked), keys, id_column, season)
    publish_table(as_json(listed(spark, folder)), f"{target}/hotspots")
    publish_table(as_json(reports), f"{target}/reports")
    publish_table(statuses, f"{target}/statuses")


if __name__ == "__main__":
    if len(sys.argv) not in (4, 5) or sys.argv[4:] not in ([], ["grid"], ["cluster"]):
        sys.exit("usage: serve.py <result folder> <requests parquet> <output folder> [grid|cluster]")
    run(job_session("cellweek-serve"), *sys.argv[1:])
