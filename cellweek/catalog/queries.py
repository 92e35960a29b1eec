"""Registered queries: name -> function of (spark, folder of test tables)."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweek.catalog import views
from cellweek.functions import holidays, scalars
from cellweek.operators import (
    clean,
    clusters,
    dbscan,
    density,
    grid,
    holiday_join,
    nearest,
    requests,
    rollout,
    seasonal,
    weekly,
)
from cellweek.plans import cluster_forecast, serve
from cellweek.schema import INCIDENT_SCHEMA, SEASON_GRID
from cellweek.sources import incidents as io
from cellweek.sources.scratch import materialize, scratch_path

SERIES = ["hotspot_id_x", "hotspot_id_y"]
TODAY = "2001-08-15"


def clean_incidents(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_incidents(views.raw_incidents(spark, folder)).withColumnRenamed(
        "Primary Type", "primary_type"
    )


def clean_projected(spark, folder):
    return _projected(clean.clean_projected(views.raw_incidents(spark, folder)))


def _projected(cleaned):
    return cleaned.select(
        F.col("ID").cast("bigint").alias("id"),
        F.col("Date").alias("ts"),
        F.col("X Coordinate").alias("x"),
        F.col("Y Coordinate").alias("y"),
        "is_holiday",
    )


def clean_row_counts(spark, folder):
    """The counts that the cleaning write observes, beside those of the written table."""
    counted = clean.write_counted(views.raw_incidents(spark, folder), clean.clean_incidents, path := scratch_path(spark))
    stored = io.read_table(spark, path).agg(F.count(F.lit(1)).alias("clean_rows"))
    return stored.join(counted, "clean_rows").select("raw_rows", "clean_rows")


def first_rows(spark, folder):
    return clean.first_rows(views.incidents(spark, folder).select("id", "Timestamp").orderBy("id"))


def csv_lenient(spark, folder):
    """The projected cleaning over a CSV file whose coordinates are read as text."""
    path = scratch_path(spark)
    io.write_csv(views.raw_incidents(spark, folder), path)
    return _projected(clean.clean_projected(io.read_incident_csv(spark, path, lenient=True)))


def parse_timestamp(spark, folder):
    return views.raw_incidents(spark, folder).select(
        F.col("ID").cast("bigint").alias("id"),
        scalars.parse_timestamp("Date").alias("ts"),
        scalars.to_number(F.coalesce("Date", "Block")).alias("as_number"),
        scalars.to_number(F.col("Case Number").substr(F.lit(2), F.lit(20))).alias("case_number"),
        scalars.to_number(
            F.concat(
                F.col("Case Number").substr(F.lit(2), F.lit(20)),
                F.element_at(F.array(F.lit(""), F.lit("d"), F.lit(".5F")), (F.col("ID") % 3 + 1).cast("int")),
            )
        ).alias("suffixed"),
    )


def date_features(spark, folder):
    rows = views.incidents(spark, folder).select("id", "Timestamp")
    return clean.date_features(rows).select(
        "id",
        *[F.col(c).cast("bigint").alias(c.lower()) for c in ("Year", "Month", "Week", "DayOfWeek")],
        scalars.week_end("Timestamp").alias("week_end"),
        scalars.iso_day("Timestamp").alias("iso_day"),
        scalars.weeks_between(F.lit("2001-12-31"), "Timestamp").alias("weeks_to_2002"),
    )


def holiday_calendar(spark, folder):
    return holidays.calendar_of(views.incidents(spark, folder))


def year_range(spark, folder):
    return holidays.year_range(views.incidents(spark, folder)).select(
        F.col("first_year").cast("bigint").alias("first_year"),
        F.col("last_year").cast("bigint").alias("last_year"),
    )


def holiday_flag(spark, folder):
    return holiday_join.flag_holidays(views.incidents(spark, folder)).select(
        "id", "date_only", "holiday_date", "is_holiday"
    )


def holiday_join_calendar(spark, folder):
    rows = views.incidents(spark, folder)
    return holiday_join.join_calendar(rows, holidays.calendar_of(rows)).select(
        "id", "date_only", "holiday_date", "is_holiday"
    )


def grid_cell_counts(spark, folder):
    return grid.cell_counts(grid.assign_cells(views.incidents(spark, folder)))


def grid_hotspots(spark, folder):
    return grid.grid_hotspots(views.incidents(spark, folder)).drop("hotspot_id_combined")


def hotspot_combined_id(spark, folder):
    return grid.grid_hotspots(views.incidents(spark, folder))


def grid_hotspots_approximate(spark, folder):
    """The cells that any threshold within the stated error calls hot, and whether they were found.

    A cell that no such threshold calls hot would come as a row of its own.
    """
    rows = views.incidents(spark, folder)
    counts = grid.cell_counts(grid.assign_cells(rows)).toDF("hotspot_id_x", "hotspot_id_y", "crime_count")
    found = grid.grid_hotspots(rows, relative_error=0.01).select("hotspot_id_x", "hotspot_id_y", F.lit(True).alias("hot"))
    marked = counts.join(found, SERIES, "left").withColumn("found", F.coalesce("hot", F.lit(False))).drop("hot")
    sure = F.col("crime_count") > grid.count_threshold(counts, 0.96)
    never = F.col("crime_count") <= grid.count_threshold(counts, 0.94)
    return marked.where(sure | (never & F.col("found")))


def grid_hotspot_summary(spark, folder):
    return grid.hotspot_summary(grid.grid_hotspots(views.incidents(spark, folder))).select(
        "hotspot_id_x",
        "hotspot_id_y",
        F.col("centroid.lat").alias("lat"),
        F.col("centroid.lon").alias("lon"),
        "crime_count",
        "marker_radius",
    )


def grid_hotspot_json(spark, folder):
    summary = grid.hotspot_summary(grid.grid_hotspots(views.incidents(spark, folder)))
    written = requests.as_json(summary, ["id", "centroid", "crime_count"])
    record = F.from_json("json", "id bigint, centroid struct<lat: double, lon: double>, crime_count bigint")
    return written.select(record.alias("r")).select("r.id", "r.centroid.lat", "r.centroid.lon", "r.crime_count")


def hotspot_definitions(spark, folder):
    """The definitions written and read back, as the hotspot list."""
    target = scratch_path(spark)
    io.publish_table(grid.grid_hotspots(views.incidents(spark, folder)), f"{target}/hotspot_definitions")
    return serve.hotspot_list(spark, target).select("id", "centroid.lat", "centroid.lon", "crime_count")


def approximate_threshold(spark, folder):
    """The exact quantiles one stated error below and above, and whether the approximate one lies between."""
    counts = grid.cell_counts(grid.assign_cells(views.incidents(spark, folder)))
    low, high = grid.count_threshold(counts, 0.94), grid.count_threshold(counts, 0.96)
    return counts.agg(F.count(F.lit(1)).alias("n_cells")).select(
        "n_cells", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"),
        grid.count_threshold(counts, relative_error=0.01).between(low, high).alias("within"),
    )


def top_hotspots(spark, folder):
    return grid.top_hotspots(grid.grid_hotspots(views.incidents(spark, folder))).drop("hotspot_id_combined")


def hotspot_incidents(spark, folder):
    rows = views.incidents(spark, folder)
    return grid.hotspot_incidents(rows, grid.grid_hotspots(rows)).select(
        "id", "hotspot_id_x", "hotspot_id_y", "crime_count"
    )


def _series(spark, folder):
    weeks = materialize(weekly.cell_weeks(views.incidents(spark, folder)))
    return weekly.hotspot_series_from_weeks(weeks, weekly.hotspots_from_weeks(weeks))


def weekly_series(spark, folder):
    return _series(spark, folder)


def weekly_holiday_incidents(spark, folder):
    return weekly.weekly_counts(grid.assign_cells(views.incidents(spark, folder)), grid.CELL)


def series_span(spark, folder):
    return weekly.series_span(_series(spark, folder), SERIES)


def series_with_history(spark, folder):
    rows = grid.assign_cells(views.incidents(spark, folder))
    return weekly.long_enough(weekly.weekly_series(rows, grid.CELL), grid.CELL, 330)


def future_weeks_exog(spark, folder):
    spans = weekly.series_span(_series(spark, folder), SERIES).withColumn(
        "until", F.lit("2002-12-31").cast("date")
    )
    return holiday_join.weeks_ahead(rollout.future_weeks(spans, SERIES, "until"))


def seasonal_features(spark, folder):
    return seasonal.difference(_series(spark, folder), SERIES, SEASON_GRID).select(
        *SERIES, "week_end", "y", "y_lag1", "y_lags", "y_lags1", "w", "dx"
    )


def seasonal_cross_products(spark, folder):
    lagged, terms = seasonal.first_stage(_series(spark, folder), SERIES, SEASON_GRID)
    sums = seasonal.cross_products(lagged, SERIES, terms, "w")
    return sums.select(*SERIES, "n_obs", F.posexplode("xy").alias("term", "total")).select(
        *SERIES, "n_obs", F.col("term").cast("bigint").alias("term"), "total"
    )


def _models(spark, folder):
    return materialize(seasonal.fit_seasonal(_series(spark, folder), SERIES, SEASON_GRID))


def fit_seasonal(spark, folder):
    return _models(spark, folder).select(
        *SERIES, "status", "n_weeks", "n_obs", "last_week", F.posexplode("coef").alias("term", "value")
    ).withColumn("value", F.round("value", 6))


def seasonal_errors(spark, folder):
    """The squared error of each fit, which is never above that of its linear start."""
    return _models(spark, folder).where("model = 'seasonal'").select(
        *SERIES,
        "n_obs",
        F.round("squared_error", 6).alias("squared_error"),
        (F.col("squared_error") <= F.col("linear_error")).alias("not_worse"),
    )


def training_outcomes(spark, folder):
    rows = grid.assign_cells(views.incidents(spark, folder))
    series = weekly.weekly_series(rows, grid.CELL)
    models = seasonal.fit_seasonal(series, grid.CELL, SEASON_GRID, min_weeks=330)
    return seasonal.training_outcomes(models, grid.CELL)


def train_each(spark, folder):
    def enough(pdf):
        if len(pdf) < 335:
            raise ValueError("short series")

    rows = grid.assign_cells(views.incidents(spark, folder))
    return seasonal.train_each(weekly.weekly_series(rows, grid.CELL), grid.CELL, enough)


def forecast_weeks(spark, folder):
    models = _models(spark, folder).withColumn("until", F.lit("2001-12-31").cast("date"))
    return rollout.forecast_rows(models, SERIES, SEASON_GRID, "until").withColumn("predicted", F.round("predicted", 6))


def model_lookup(spark, folder):
    """One model out of the stored table, found by the pair of its cell indexes."""
    path = scratch_path(spark)
    io.publish_models(seasonal.fit_seasonal(_series(spark, folder), SERIES, SEASON_GRID), path, SERIES)
    models = io.read_table(spark, path)
    first = models.agg(F.min(F.struct(*SERIES)).alias("cell")).first()["cell"]
    return io.model_for(models, first[0], first[1]).select(
        *SERIES, "n_weeks", "last_week", F.round(F.col("coef")[0], 6).alias("ar"), F.round(F.col("coef")[1], 6).alias("sar")
    )


def forecast_by_id(spark, folder):
    """Forecasts asked for by short ids of which there are so few that they collide."""
    short = F.pmod(F.col("hotspot_id_x") + F.col("hotspot_id_y"), F.lit(5)).alias("short_id")
    models = _models(spark, folder).select("*", short)
    asked = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("request_id"),
        (F.col("c_custkey") % 7).alias("short_id"),
        F.lit("2002-03-01").cast("date").alias("start_date"),
        F.lit("2002-04-30").cast("date").alias("end_date"),
    )
    named = requests.resolve_ids(asked, models, SERIES, "short_id")
    sliced = requests.request_forecasts(named, models.drop("short_id"), SERIES, SEASON_GRID)
    return sliced.select(
        "request_id", "short_id", *SERIES, "status",
        F.coalesce(F.size("predicted"), F.lit(0)).cast("bigint").alias("n_weeks"),
        F.round(F.aggregate("predicted", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )


def trend_forecast(spark, folder):
    """Series of 60 weeks are too short for the seasonal terms and follow their trend."""
    order = Window.partitionBy(*SERIES).orderBy("week_end")
    short = _series(spark, folder).withColumn("_n", F.row_number().over(order)).where("_n <= 60").drop("_n")
    models = seasonal.fit_seasonal(short, SERIES, SEASON_GRID)
    until = models.withColumn("until", F.date_add("last_week", 70))
    return rollout.forecast_rows(until, SERIES, SEASON_GRID, "until").select(
        *SERIES, "week_end", F.round("predicted", 6).alias("predicted")
    )


def forecast_requests(spark, folder):
    today = F.lit(TODAY).cast("date")
    return requests.resolve_requests(
        views.requests(spark, folder), _models(spark, folder), SERIES, today
    ).select(
        "request_id", *SERIES, "start_date", "end_date", "status",
        F.col("code").cast("bigint").alias("code"),
        F.when(F.col("status") == "ok", F.col("first_label")).alias("first_label"),
        F.when(F.col("status") == "ok", F.col("last_label")).alias("last_label"),
    )


def _reports(spark, folder):
    models = _models(spark, folder).withColumn(
        "hotspot_id", scalars.combined_id("hotspot_id_x", "hotspot_id_y")
    )
    asked = views.requests(spark, folder).withColumn(
        "hotspot_id", scalars.combined_id("hotspot_id_x", "hotspot_id_y")
    )
    today = F.lit(TODAY).cast("date")
    sliced = requests.request_forecasts(asked, models, SERIES, SEASON_GRID, today)
    return requests.forecast_reports(sliced, "hotspot_id")


def _report_rows(reports):
    """The nested reports, one row per week."""
    return reports.select("*", F.explode("forecast_breakdown").alias("b")).select(
        "request_id", "hotspot_id",
        F.col("forecast_period.start").alias("period_start"),
        F.col("forecast_period.end").alias("period_end"),
        "total_predicted_crimes", "b.date", "b.predicted_crimes", "b.is_holiday_week",
    )


def forecast_report(spark, folder):
    return _report_rows(_reports(spark, folder))


def forecast_report_json(spark, folder):
    """The reports written as JSON and parsed again."""
    reports = _reports(spark, folder)
    record = F.from_json("json", reports.schema)
    return _report_rows(requests.as_json(reports).select(record.alias("r")).select("r.*"))


def forecast_report_weeks(spark, folder):
    """The whole numbers that a reader sees."""
    return requests.report_lines(_reports(spark, folder)).select(
        "request_id", "date", "is_holiday_week", "total_shown", "shown"
    )


def csv_parquet_roundtrip(spark, folder):
    csv, parquet = scratch_path(spark), scratch_path(spark)
    io.write_csv(views.raw_incidents(spark, folder), csv)
    io.write_table(io.read_incident_csv(spark, csv), parquet)
    return io.read_table(spark, parquet, INCIDENT_SCHEMA).select(
        F.col("ID").cast("bigint").alias("id"),
        F.col("Case Number").alias("case_number"),
        F.col("Date").alias("date_text"),
        F.col("Primary Type").alias("primary_type"),
        F.col("X Coordinate").alias("x"),
        F.when(~F.isnan("Latitude"), F.col("Latitude")).alias("latitude"),
        F.when(F.col("Latitude").isNotNull(), F.isnan("Latitude")).alias("not_a_number"),
        F.col("Longitude").alias("longitude"),
        F.col("Location").alias("location"),
    )


def knn_kdist(spark, folder):
    return nearest.k_distance(views.points(spark, folder)).select("id", "k_dist")


def nearest_other(spark, folder):
    return nearest.nearest_other(views.points(spark, folder))


def density_levels(spark, folder):
    k_dist = nearest.k_distance(views.points(spark, folder))
    return density.density_levels(k_dist, s=500).select("rank", "id", "variation", "smoothed", "in_level")


EPS, MIN_PTS = 1.25, 10


def _labelled(spark, folder):
    rows = views.points(spark, folder)
    labels = materialize(dbscan.dbscan(rows, EPS, MIN_PTS))
    return clusters.attach_labels(rows, labels)


def dbscan_labels(spark, folder):
    return dbscan.dbscan(views.points(spark, folder), EPS, MIN_PTS)


def cluster_summary(spark, folder):
    return clusters.cluster_summary(_labelled(spark, folder), "y", "x").select(
        "id", F.round("centroid.lat", 6).alias("lat"), F.round("centroid.lon", 6).alias("lon"), "crime_count"
    )


def cluster_pages(spark, folder):
    report = clusters.cluster_report(_labelled(spark, folder), "y", "x", page_size=100)
    return report.select("id", "page", "crime_count", F.posexplode("points").alias("place", "point")).select(
        "id", "page", "crime_count", F.col("place").cast("bigint").alias("place"),
        F.col("point.Latitude").alias("lat"), F.col("point.Longitude").alias("lon"),
    )


def cluster_report_json(spark, folder):
    report = clusters.cluster_report(_labelled(spark, folder), "y", "x", page_size=100)
    schema = "id bigint, page bigint, crime_count bigint, points array<struct<Latitude: double, Longitude: double>>"
    record = F.from_json(F.col("json"), schema)
    return requests.as_json(report).select(record.alias("r")).select(
        "r.id", "r.page", "r.crime_count", F.size("r.points").cast("bigint").alias("n_points")
    )


def cluster_ids(spark, folder):
    return clusters.cluster_ids(_labelled(spark, folder))


def dbscan_unplaced(spark, folder):
    """Every tenth point has no number as its x; those are noise and near nobody."""
    rows = views.points(spark, folder).withColumn(
        "x", F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("x"))
    )
    return dbscan.dbscan(rows, EPS, MIN_PTS)


def cluster_job_rows(spark, folder):
    """Labels written and read back for rows whose incident IDs repeat or are missing."""
    rows = views.points(spark, folder).select(
        F.when(F.col("id") % 7 != 0, F.col("id") % 500 + 5_000_000_000).alias("ID"),
        F.col("x").alias("X Coordinate"),
        F.col("y").alias("Y Coordinate"),
    )
    stored = cluster_forecast.keyed(rows)
    labels = cluster_forecast.store_labels(stored, scratch_path(spark), EPS, MIN_PTS)
    return clusters.attach_labels(stored.drop("incident_id"), labels).select(
        "incident_id",
        F.col("X Coordinate").alias("x"),
        F.col("Y Coordinate").alias("y"),
        (F.col("cluster") == clusters.NOISE).alias("is_noise"),
    )


def cluster_counts(spark, folder):
    return clusters.label_counts(_labelled(spark, folder))


def cluster_totals(spark, folder):
    return clusters.label_totals(_labelled(spark, folder))


QUERIES = {
    f.__name__: f
    for f in [
        clean_incidents,
        clean_projected,
        clean_row_counts,
        first_rows,
        csv_lenient,
        parse_timestamp,
        date_features,
        holiday_calendar,
        year_range,
        holiday_flag,
        holiday_join_calendar,
        grid_cell_counts,
        grid_hotspots,
        hotspot_combined_id,
        grid_hotspots_approximate,
        grid_hotspot_summary,
        grid_hotspot_json,
        hotspot_definitions,
        approximate_threshold,
        top_hotspots,
        hotspot_incidents,
        weekly_series,
        weekly_holiday_incidents,
        series_span,
        series_with_history,
        future_weeks_exog,
        seasonal_features,
        seasonal_cross_products,
        fit_seasonal,
        seasonal_errors,
        training_outcomes,
        train_each,
        forecast_weeks,
        model_lookup,
        forecast_by_id,
        trend_forecast,
        forecast_requests,
        forecast_report,
        forecast_report_json,
        forecast_report_weeks,
        csv_parquet_roundtrip,
        knn_kdist,
        nearest_other,
        density_levels,
        dbscan_labels,
        cluster_summary,
        cluster_pages,
        cluster_report_json,
        cluster_counts,
        cluster_totals,
        cluster_ids,
        dbscan_unplaced,
        cluster_job_rows,
    ]
}
