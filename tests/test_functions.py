import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from cellweek.functions import holidays, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_dates_of_every_accepted_form(spark):
    texts = {
        "01/05/2024 03:04:05 PM": dt.datetime(2024, 1, 5, 15, 4, 5),
        "1/5/2024 3:04:05 AM": dt.datetime(2024, 1, 5, 3, 4, 5),
        "12/31/2023 12:00:00 AM": dt.datetime(2023, 12, 31, 0, 0),
        "12/31/2023 12:00:00 PM": dt.datetime(2023, 12, 31, 12, 0),
        "02/30/2024 01:00:00 PM": None,
        "2024-01-05": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in rows.select("t", scalars.parse_timestamp("t").alias("v")).collect()}
    assert got == texts


def test_weeks_end_on_sunday(spark):
    rows = [
        ("2024-01-01 00:00:00", "2024-01-07"),
        ("2024-01-07 23:59:59", "2024-01-07"),
        ("2024-01-08 00:00:00", "2024-01-14"),
        ("2024-01-21 12:00:00", "2024-01-21"),
        ("2024-02-29 08:00:00", "2024-03-03"),
    ]
    df = spark.createDataFrame(rows, "ts string, w string").select(
        "w", F.date_format(scalars.week_end(F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("v")
    )
    assert all(r.w == r.v for r in df.collect())
    steps = scalars.weeks_between(F.lit("2024-02-01").cast("date"), F.lit("2024-01-07").cast("date"))
    assert one(spark, steps) == 4


def test_rounding_equals_numpy(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, 3.14159, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.r for r in df.select(scalars.round_cents("v").alias("r")).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_cells_and_ids(spark):
    assert one(spark, scalars.cell_index(F.lit(-87.6285))) == -87629
    assert one(spark, scalars.cell_index(F.lit(41.8785))) == 41878
    assert abs(one(spark, scalars.cell_centre(F.lit(-87629))) + 87.6285) < 1e-9
    ids = spark.range(1000).select(scalars.combined_id(F.col("id"), -F.col("id")).alias("v"))
    assert ids.where("v < 0 OR v >= 100000").count() == 0
    assert ids.schema["v"].dataType.simpleString() == "bigint"


def test_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), (" 2 ",)], "t string")
    assert [r.v for r in df.select(scalars.to_number("t").alias("v")).collect()] == [1.5, None, None, 2.0]


def days(*texts):
    return {dt.date.fromisoformat(t) for t in texts}


def test_holidays_of_one_year(spark):
    got = {r.holiday_date for r in holidays.holiday_calendar(spark, 2024, 2024).collect()}
    assert got == days(
        "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04",
        "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25",
    )


def test_observed_days(spark):
    got = {r.holiday_date for r in holidays.holiday_calendar(spark, 2021, 2023).collect()}
    assert days("2021-12-24", "2021-12-25", "2021-12-31", "2022-01-01", "2023-01-01", "2023-01-02") <= got
    assert days("2021-06-18", "2021-07-05", "2022-06-20", "2022-12-26", "2023-11-10") <= got
    assert not days("2020-06-19", "2021-12-26") & got


def test_older_rules(spark):
    got = {r.holiday_date for r in holidays.holiday_calendar(spark, 1970, 1978).collect()}
    assert days("1970-02-22", "1970-05-30", "1970-10-12", "1971-02-15", "1975-10-27", "1978-11-11") <= got
    assert not days("1971-02-22", "1975-11-11", "1978-10-23", "1978-01-16") & got


def test_holiday_counts_of_weeks(spark):
    labels = [dt.date(2020, 1, 5) + dt.timedelta(weeks=k) for k in range(300)]
    weeks = spark.createDataFrame([(d,) for d in labels], "week_end date")
    closed = {r.holiday_date for r in holidays.holiday_calendar(spark, 2019, 2026).collect()}
    for ahead, steps in ((False, range(-6, 1)), (True, range(7))):
        got = {r.week_end: r.n for r in holidays.add_week_holidays(weeks, weeks, "n", ahead=ahead).collect()}
        assert got == {d: sum(d + dt.timedelta(k) in closed for k in steps) for d in labels}
    assert got[dt.date(2022, 12, 25)] == 2 and got[dt.date(2023, 12, 31)] == 1
    assert holidays.add_week_holidays(weeks.limit(0), weeks.limit(0), "n").count() == 0


def test_calendar_of_empty_data(spark):
    empty = spark.createDataFrame([], "Timestamp timestamp")
    assert holidays.calendar_of(empty).count() == 0
