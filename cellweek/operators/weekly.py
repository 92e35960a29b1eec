"""Regular weekly series per hotspot, built by aggregation before any modelling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweek.functions.holidays import add_week_holidays, is_holiday
from cellweek.functions.scalars import week_end
from cellweek.operators.grid import CELL, assign_cells, hotspots_of
from cellweek.operators.skew import lookup_join
from cellweek.schema import CELL_SIZE, HOT_QUANTILE
from cellweek.sources.scratch import materialize


def weekly_counts(df: DataFrame, keys: list[str], ts: str = "Timestamp", holiday: Column | None = None) -> DataFrame:
    """Incidents and holiday incidents per key and week, only for weeks that occur.

    Partial aggregation reduces each task to one row per key and week before the shuffle.
    """
    flag = is_holiday(ts) if holiday is None else holiday
    return df.groupBy(*keys, week_end(ts).alias("week_end")).agg(
        F.count(F.lit(1)).alias("y"), F.sum(flag.cast("bigint")).alias("holiday_incidents")
    )


def fill_weeks(weekly: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Insert the missing weeks of each series with zeros, from its first to its last week.

    Every row emits itself and the empty weeks up to the next one, so neither a spine table
    nor a join is needed. A series has at most one row per calendar week.
    """
    following = F.lead("week_end").over(Window.partitionBy(*keys).orderBy("week_end"))
    last = F.coalesce(F.date_sub(following, 7), F.col("week_end"))
    every_week = F.sequence("week_end", "_last", F.expr("interval 7 days"))
    exploded = weekly.withColumn("_last", last).select(
        *keys, F.posexplode(every_week).alias("_gap", "_label"), *measures
    )
    return exploded.select(
        *keys,
        F.col("_label").alias("week_end"),
        *[F.when(F.col("_gap") == 0, F.col(m)).otherwise(F.lit(0).cast("bigint")).alias(m) for m in measures],
    )


def weekly_series(df: DataFrame, keys: list[str], ts: str = "Timestamp", holiday: Column | None = None) -> DataFrame:
    """keys, week_end, y, holiday_incidents, holiday_days with no missing weeks.

    The counts are written first: they give the rows and the span of the holiday table.
    """
    counts = materialize(weekly_counts(df, keys, ts, holiday))
    return with_holiday_days(fill_weeks(counts, keys, ["y", "holiday_incidents"]), counts)


def with_holiday_days(series: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the holidays of each Monday-to-Sunday week; known is a stored table that spans the weeks."""
    return add_week_holidays(series, known, "holiday_days")


def cell_weeks(incidents: DataFrame, size: float = CELL_SIZE) -> DataFrame:
    """Incidents per cell and week: the one pass over the raw table that the grid needs."""
    return weekly_counts(assign_cells(incidents, size), CELL)


def hotspots_from_weeks(weeks: DataFrame, q: float = HOT_QUANTILE, relative_error: float = 0.0) -> DataFrame:
    counts = weeks.groupBy(*CELL).agg(F.sum("y").alias("crime_count"))
    return hotspots_of(counts, q, relative_error)


def hotspot_series_from_weeks(weeks: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Weekly series of the hotspot cells, from the stored cell-week table."""
    lookup = hotspots.select(
        F.col("hotspot_id_x").alias("grid_x"), F.col("hotspot_id_y").alias("grid_y")
    )
    named = (
        lookup_join(weeks, lookup, CELL)
        .withColumnRenamed("grid_x", "hotspot_id_x")
        .withColumnRenamed("grid_y", "hotspot_id_y")
    )
    return with_holiday_days(
        fill_weeks(named, ["hotspot_id_x", "hotspot_id_y"], ["y", "holiday_incidents"]), weeks
    )


def series_span(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.min("week_end").alias("first_week"),
        F.max("week_end").alias("last_week"),
        F.count(F.lit(1)).alias("n_weeks"),
    )


def long_enough(series: DataFrame, keys: list[str], min_weeks: int) -> DataFrame:
    """Series with at least min_weeks rows."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return series.withColumn("_weeks", size).where(F.col("_weeks") >= min_weeks).drop("_weeks")
