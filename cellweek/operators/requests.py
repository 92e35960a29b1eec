"""Forecast requests as a table: validation, slicing and reports for many at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.functions.scalars import iso_day, round_cents, week_end, weeks_between
from cellweek.operators.rollout import forecast_blocks, trained
from cellweek.operators.skew import lookup_join
from cellweek.schema import DEFAULT_WINDOW_WEEKS
from cellweek.sources.scratch import materialize

# The response code of each outcome.
CODES = {
    "ok": 200,
    "not_found": 404,
    "start_after_end": 400,
    "end_before_training": 400,
    "empty_slice": 400,
}


def default_window(requests: DataFrame, today: Column | None = None) -> DataFrame:
    """Replaces both bounds when either is missing by today and today + 4 weeks."""
    now = F.current_date() if today is None else today
    missing = F.col("start_date").isNull() | F.col("end_date").isNull()
    return requests.withColumns(
        {
            "start_date": F.when(missing, now).otherwise(F.col("start_date")),
            "end_date": F.when(missing, F.date_add(now, 7 * DEFAULT_WINDOW_WEEKS)).otherwise(F.col("end_date")),
        }
    )


def resolve_requests(
    requests: DataFrame, models: DataFrame, keys: list[str], today: Column | None = None
) -> DataFrame:
    """Adds last_week, first_label, last_label, steps, status and code to each request.

    The labels are the forecast Sundays inside the closed window.
    """
    known = trained(models).select(*keys, "last_week")
    joined = lookup_join(default_window(requests, today), known, keys, "left")
    steps = weeks_between("end_date", "last_week")
    first = F.greatest(week_end("start_date"), F.date_add("last_week", 7))
    end_label = week_end("end_date")
    last = F.when(end_label > F.col("end_date"), F.date_sub(end_label, 7)).otherwise(end_label)
    status = (
        F.when(F.col("last_week").isNull(), "not_found")
        .when(F.col("start_date") > F.col("end_date"), "start_after_end")
        .when(F.col("steps") <= 0, "end_before_training")
        .when(F.col("first_label") > F.col("last_label"), "empty_slice")
        .otherwise("ok")
    )
    code = F.create_map(*[F.lit(v) for pair in CODES.items() for v in pair])
    return (
        joined.withColumns({"steps": steps, "first_label": first, "last_label": last})
        .withColumn("status", status)
        .withColumn("code", code[F.col("status")])
    )


def resolve_ids(asked: DataFrame, models: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """One request per cell that has the asked short id, named by its keys.

    Short ids can collide; each cell then has an answer of its own. An unknown id keeps one
    request with NULL keys, which finds no model.
    """
    named = trained(models).select(id_column, *keys).distinct()
    return lookup_join(asked, named, [id_column], "left")


def request_forecasts(
    requests: DataFrame,
    models: DataFrame,
    keys: list[str],
    season: int,
    today: Column | None = None,
) -> DataFrame:
    """Resolved requests with the arrays weeks, predicted and holiday_count of their windows.

    Each series is rolled out once, to the latest date anyone asks for. A request joins the
    seasons that its window touches and takes its part of each, so many requests for one hotspot
    cost no extra model work and no row holds more than the weeks asked for.
    """
    resolved = materialize(
        resolve_requests(requests, models, keys, today).withColumn("_request", F.monotonically_increasing_id())
    )
    weeks = lambda later, earlier: (F.datediff(later, earlier) / 7).cast("bigint")
    first = weeks(F.col("first_label"), F.date_add("last_week", 7))
    asked = resolved.where("status = 'ok'").select(
        "_request", *keys, "end_date", first.alias("_first"), (first + weeks(F.col("last_label"), F.col("first_label"))).alias("_last")
    )
    horizon = asked.groupBy(*keys).agg(F.max("end_date").alias("_until"))
    wanted = materialize(lookup_join(models, horizon, keys))
    blocks = forecast_blocks(wanted, keys, season, "_until").drop("first_week").withColumnRenamed("block", "_block")
    season_of = lambda week: F.floor(F.col(week) / season)
    touched = asked.withColumn("_block", F.explode(F.sequence(season_of("_first"), season_of("_last"))))
    joined = lookup_join(touched, blocks, [*keys, "_block"])
    start = F.greatest(F.col("_first") - F.col("_block") * season, F.lit(0))
    end = F.least(F.col("_last") - F.col("_block") * season, F.lit(season - 1))
    part = lambda c: F.slice(c, (start + 1).cast("int"), (end - start + 1).cast("int")).alias(c)
    parts = joined.groupBy("_request").agg(
        F.array_sort(F.collect_list(F.struct("_block", part("predicted"), part("holiday_count")))).alias("_parts")
    )
    whole = lambda c: F.flatten(F.transform("_parts", lambda r: r[c])).alias(c)
    sliced = parts.select("_request", whole("predicted"), whole("holiday_count"))
    every_week = F.sequence("first_label", "last_label", F.expr("interval 7 days"))
    return (
        resolved.join(sliced, "_request", "left")
        .withColumn("weeks", F.when(F.col("status") == "ok", every_week))
        .drop("_request")
    )


def forecast_reports(sliced: DataFrame, id_column: str) -> DataFrame:
    """hotspot_id, forecast_period, total_predicted_crimes, forecast_breakdown per request.

    The total is rounded from the unrounded predictions. The field names are fixed values.
    """
    total = F.aggregate("predicted", F.lit(0.0), lambda a, v: a + v)
    breakdown = F.transform(
        F.arrays_zip("weeks", "predicted", "holiday_count"),
        lambda r: F.struct(
            iso_day(r["weeks"]).alias("date"),
            round_cents(r["predicted"]).alias("predicted_crimes"),
            (r["holiday_count"] > 0).alias("is_holiday_week"),
        ),
    )
    period = F.struct(
        iso_day(F.element_at("weeks", 1)).alias("start"), iso_day(F.element_at("weeks", -1)).alias("end")
    )
    return sliced.where("status = 'ok'").select(
        "request_id",
        F.col(id_column).cast("bigint").alias("hotspot_id"),
        period.alias("forecast_period"),
        round_cents(total).alias("total_predicted_crimes"),
        breakdown.alias("forecast_breakdown"),
    )


def report_lines(reports: DataFrame) -> DataFrame:
    """One row per request and week, with the whole numbers shown to a reader."""
    return reports.select(
        "request_id",
        "hotspot_id",
        F.floor("total_predicted_crimes").alias("total_shown"),
        F.explode("forecast_breakdown").alias("b"),
    ).select(
        "request_id",
        "hotspot_id",
        "total_shown",
        F.col("b.date").alias("date"),
        F.floor("b.predicted_crimes").alias("shown"),
        F.col("b.is_holiday_week").alias("is_holiday_week"),
    )


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))
