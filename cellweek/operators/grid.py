"""Grid hotspots: fixed-size cells whose incident count lies above a quantile."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.functions.scalars import cell_centre, cell_index, combined_id, marker_radius
from cellweek.operators.skew import lookup_join
from cellweek.schema import CELL_SIZE, HOT_QUANTILE

CELL = ["grid_x", "grid_y"]


def assign_cells(df: DataFrame, size: float = CELL_SIZE) -> DataFrame:
    return df.withColumns(
        {"grid_x": cell_index("Longitude", size), "grid_y": cell_index("Latitude", size)}
    )


def cell_counts(cells: DataFrame) -> DataFrame:
    """Incidents per cell; combined on the map side, so a hot cell costs one row per task."""
    return cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("crime_count"))


def count_threshold(counts: DataFrame, q: float = HOT_QUANTILE, relative_error: float = 0.0) -> Column:
    """The q-quantile of the cell counts, for use in a filter.

    Exact by default: a scalar subquery of percentile_disc. Its state holds one entry per
    *distinct* count, and n incidents have fewer than sqrt(2n) distinct counts, so it stays
    small. With a relative error the quantile comes from a mergeable sketch: every task leaves
    one, and the rank of the result is off by at most relative_error times the number of cells.
    """
    if relative_error > 0:
        sketch = F.percentile_approx("crime_count", F.lit(float(q)), F.lit(math.ceil(1 / relative_error)))
        return counts.agg(sketch.alias("threshold")).scalar()
    return counts.agg(
        F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY crime_count)").alias("threshold")
    ).scalar()


def hotspots_of(counts: DataFrame, q: float = HOT_QUANTILE, relative_error: float = 0.0) -> DataFrame:
    """Cells strictly above the quantile. Ties at the threshold are excluded."""
    return (
        counts.where(F.col("crime_count") > count_threshold(counts, q, relative_error))
        .withColumnRenamed("grid_x", "hotspot_id_x")
        .withColumnRenamed("grid_y", "hotspot_id_y")
        .withColumn("hotspot_id_combined", combined_id("hotspot_id_x", "hotspot_id_y"))
    )


def grid_hotspots(
    incidents: DataFrame,
    size: float = CELL_SIZE,
    q: float = HOT_QUANTILE,
    relative_error: float = 0.0,
) -> DataFrame:
    """hotspot_id_x, hotspot_id_y, crime_count, hotspot_id_combined."""
    return hotspots_of(cell_counts(assign_cells(incidents, size)), q, relative_error)


def top_hotspots(hotspots: DataFrame, n: int = 10) -> DataFrame:
    """The n largest hotspots, ties in cell order."""
    return hotspots.orderBy(F.desc("crime_count"), "hotspot_id_x", "hotspot_id_y").limit(n)


def hotspot_summary(hotspots: DataFrame, size: float = CELL_SIZE) -> DataFrame:
    """id, centroid struct and count, with the radius of the map marker."""
    centroid = F.struct(
        cell_centre("hotspot_id_y", size).alias("lat"), cell_centre("hotspot_id_x", size).alias("lon")
    )
    return hotspots.select(
        F.col("hotspot_id_combined").cast("bigint").alias("id"),
        "hotspot_id_x",
        "hotspot_id_y",
        centroid.alias("centroid"),
        F.col("crime_count").cast("bigint").alias("crime_count"),
        marker_radius("crime_count").alias("marker_radius"),
    )


def hotspot_incidents(incidents: DataFrame, hotspots: DataFrame, size: float = CELL_SIZE) -> DataFrame:
    """Incidents that lie in a hotspot cell, with the hotspot's columns."""
    lookup = hotspots.withColumns({"grid_x": F.col("hotspot_id_x"), "grid_y": F.col("hotspot_id_y")})
    return lookup_join(assign_cells(incidents, size), lookup, CELL)
