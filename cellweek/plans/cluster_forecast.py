"""Density clusters of projected coordinates and one seasonal model per cluster.

spark-submit cellweek/plans/cluster_forecast.py <input csv> <output folder>

Every cleaned row gets a key of its own, because incident IDs can repeat or be missing; labels
are joined by that key and not by position, and the ID stays as incident_id.
"""

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweek.operators.clean import clean_projected
from cellweek.operators.clusters import attach_labels, cluster_report, without_noise
from cellweek.operators.dbscan import dbscan
from cellweek.operators.seasonal import fit_seasonal, training_outcomes
from cellweek.operators.weekly import weekly_series
from cellweek.plans.session import job_session
from cellweek.schema import (
    EPS,
    MIN_POINTS,
    MIN_WEEKS_CLUSTER,
    SEASON_CLUSTER,
)
from cellweek.sources.incidents import publish_csv, publish_models, publish_table, read_incident_csv, read_table
from cellweek.sources.scratch import materialize

KEYS = ["hotspot_id"]


def keyed(cleaned: DataFrame) -> DataFrame:
    """The rows stored with id, a 64-bit key that is unique and stays once written."""
    return materialize(
        cleaned.withColumn("incident_id", F.col("ID").cast("bigint")).drop("ID").withColumn("id", F.monotonically_increasing_id())
    )


def as_points(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("X Coordinate").alias("x"), F.col("Y Coordinate").alias("y"))


def store_labels(rows: DataFrame, path: str, eps: float = EPS, min_pts: int = MIN_POINTS) -> DataFrame:
    """Writes id, incident_id and cluster of every row, and reads them back."""
    labels = dbscan(as_points(rows), eps, min_pts)
    publish_table(rows.select("id", "incident_id").join(labels, "id"), path)
    return read_table(rows.sparkSession, path)


def run(
    spark: SparkSession,
    source: str,
    folder: str,
    eps: float = EPS,
    min_pts: int = MIN_POINTS,
    season: int = SEASON_CLUSTER,
    min_weeks: int = MIN_WEEKS_CLUSTER,
) -> None:
    """Writes labels, hotspots, weekly_series, models and training_results."""
    cleaned = keyed(clean_projected(read_incident_csv(spark, source, lenient=True)))
    labels = store_labels(cleaned, f"{folder}/labels", eps, min_pts).select("id", "cluster")
    labelled = attach_labels(cleaned.select("id", "Date", "Latitude", "Longitude", "is_holiday"), labels)
    publish_table(cluster_report(labelled), f"{folder}/hotspots")
    members = without_noise(labelled).withColumn("hotspot_id", F.col("cluster").cast("bigint"))
    series = weekly_series(members, KEYS, "Date", F.col("is_holiday"))
    publish_table(series, f"{folder}/weekly_series")
    series = read_table(spark, f"{folder}/weekly_series")
    publish_models(fit_seasonal(series, KEYS, season, min_weeks), f"{folder}/models", KEYS)
    publish_csv(training_outcomes(read_table(spark, f"{folder}/models"), KEYS), f"{folder}/training_results")


if __name__ == "__main__":
    if len(sys.argv) != 3:
        sys.exit("usage: cluster_forecast.py <input csv> <output folder>")
    run(job_session("cellweek-cluster-forecast"), sys.argv[1], sys.argv[2])
