"""Grid hotspots and one seasonal model per hotspot.

spark-submit cellweek/plans/grid_forecast.py <input parquet> <output folder> [first year] [last year]

The incidents are read once. That pass leaves a table of counts per cell and week, which
gives the hotspots, their weekly series and the models.
"""

import sys

from pyspark.sql import SparkSession

from cellweek.functions.scalars import combined_id
from cellweek.operators.clean import clean_incidents
from cellweek.operators.seasonal import fit_seasonal, training_outcomes
from cellweek.operators.weekly import cell_weeks, hotspot_series_from_weeks, hotspots_from_weeks
from cellweek.plans.session import job_session
from cellweek.schema import CELL_SIZE, HOT_QUANTILE, INCIDENT_SCHEMA, SEASON_GRID
from cellweek.sources.incidents import of_years, publish_csv, publish_models, publish_table, read_table
from cellweek.sources.scratch import materialize

KEYS = ["hotspot_id_x", "hotspot_id_y"]


def run(
    spark: SparkSession,
    source: str,
    folder: str,
    size: float = CELL_SIZE,
    q: float = HOT_QUANTILE,
    relative_error: float = 0.0,
    season: int = SEASON_GRID,
    min_weeks: int = 0,
    first_year: int | None = None,
    last_year: int | None = None,
) -> None:
    """Writes hotspot_definitions, weekly_series, models and training_results."""
    raw = of_years(read_table(spark, source, INCIDENT_SCHEMA), first_year, last_year)
    incidents = clean_incidents(raw)
    weeks = materialize(cell_weeks(incidents, size))
    publish_table(hotspots_from_weeks(weeks, q, relative_error), f"{folder}/hotspot_definitions")
    hotspots = read_table(spark, f"{folder}/hotspot_definitions")
    publish_table(hotspot_series_from_weeks(weeks, hotspots), f"{folder}/weekly_series")
    series = read_table(spark, f"{folder}/weekly_series")
    models = fit_seasonal(series, KEYS, season, min_weeks).withColumn("hotspot_id_combined", combined_id(*KEYS))
    publish_models(models, f"{folder}/models", KEYS)
    publish_csv(training_outcomes(read_table(spark, f"{folder}/models"), KEYS), f"{folder}/training_results")


if __name__ == "__main__":
    if not 3 <= len(sys.argv) <= 5:
        sys.exit("usage: grid_forecast.py <input parquet> <output folder> [first year] [last year]")
    years = dict(zip(("first_year", "last_year"), map(int, sys.argv[3:])))
    run(job_session("cellweek-grid-forecast"), sys.argv[1], sys.argv[2], **years)
