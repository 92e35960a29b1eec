"""Holiday flags of incidents and of weeks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweek.functions.holidays import add_week_holidays, is_holiday
from cellweek.operators.skew import lookup_join
from cellweek.sources.scratch import materialize


def flag_holidays(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Adds date_only, holiday_date and is_holiday without a join."""
    day = F.to_date(ts)
    return df.withColumns(
        {
            "date_only": day,
            "holiday_date": F.when(is_holiday(day), day),
            "is_holiday": is_holiday(day),
        }
    )


def join_calendar(df: DataFrame, calendar: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """The same columns from a given calendar with one holiday_date column."""
    days = calendar.select(F.col("holiday_date").alias("date_only"), "holiday_date").distinct()
    joined = lookup_join(df.withColumn("date_only", F.to_date(ts)), days, ["date_only"], "left")
    return joined.withColumn("is_holiday", F.col("holiday_date").isNotNull())


def weeks_ahead(spine: DataFrame, label: str = "week_end") -> DataFrame:
    """Holidays in the seven days that start at each Sunday label, and the week's flag.

    The spine is written once, for its rows and for the span of the holiday table.
    """
    stored = materialize(spine)
    counted = add_week_holidays(stored, stored, "holiday_count", label, ahead=True)
    return counted.withColumn("is_holiday_week", F.col("holiday_count") > 0)
