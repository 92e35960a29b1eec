"""Summaries of labelled points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweek.operators.ranking import global_rank
from cellweek.operators.skew import lookup_join

NOISE = -1
PAGE = 10_000


def attach_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their cluster, joined by id rather than by position; ids must be unique."""
    return rows.join(labels, "id")


def without_noise(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("cluster") != NOISE)


def members_of(labelled: DataFrame, cluster: int) -> DataFrame:
    return labelled.where(F.col("cluster") == cluster)


def label_counts(labelled: DataFrame) -> DataFrame:
    """Rows per label, noise included, largest first."""
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster")


def label_totals(labelled: DataFrame) -> DataFrame:
    """One row: number of clusters and of noise points."""
    per_label = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return per_label.agg(
        F.count_if(F.col("cluster") != NOISE).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0)).alias("n_noise"),
    )


def cluster_ids(labelled: DataFrame) -> DataFrame:
    """Distinct labels without noise, ascending."""
    return without_noise(labelled).select("cluster").distinct().orderBy("cluster")


def cluster_summary(labelled: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """id, centroid struct and number of points of each cluster."""
    return (
        without_noise(labelled)
        .groupBy(F.col("cluster").cast("bigint").alias("id"))
        .agg(
            F.struct(F.avg(lat).alias("lat"), F.avg(lon).alias("lon")).alias("centroid"),
            F.count(F.lit(1)).alias("crime_count"),
        )
    )


def cluster_points(
    labelled: DataFrame, lat: str = "Latitude", lon: str = "Longitude", page_size: int = PAGE
) -> DataFrame:
    """All points of each cluster as arrays of at most page_size records, in id order.

    One array per cluster would grow with the data; pages keep every row bounded and lose no
    point. id, page, points.
    """
    ranked = global_rank(without_noise(labelled).select("cluster", "id", lat, lon), ["cluster", "id"], "_rank")
    first = ranked.groupBy("cluster").agg(F.min("_rank").alias("_first"))
    placed = lookup_join(ranked, first, ["cluster"]).withColumn(
        "page", F.floor((F.col("_rank") - F.col("_first")) / page_size)
    )
    record = F.struct("_rank", F.struct(F.col(lat).alias("Latitude"), F.col(lon).alias("Longitude")).alias("p"))
    return (
        placed.groupBy(F.col("cluster").cast("bigint").alias("id"), "page")
        .agg(F.array_sort(F.collect_list(record)).alias("_records"))
        .select("id", "page", F.transform("_records", lambda r: r["p"]).alias("points"))
    )


def cluster_report(labelled: DataFrame, lat: str = "Latitude", lon: str = "Longitude", page_size: int = PAGE) -> DataFrame:
    """The summary with the pages of points: id, centroid, crime_count, page, points."""
    summary = cluster_summary(labelled, lat, lon)
    return lookup_join(cluster_points(labelled, lat, lon, page_size), summary, ["id"])
