"""US federal holidays as a pure date expression and as a calendar table.

The expression needs no join and no pass over the data to find its year range, so a scan
can flag holidays while it reads. The calendar table is the same expression applied to a
run of days.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values from public US federal holiday law: (month, day, first year, last year).
# These are also observed on Friday when they fall on Saturday, on Monday when on Sunday.
OBSERVED_DATES = [
    (1, 1, None, None),  # New Year's Day
    (6, 19, 2021, None),  # Juneteenth
    (7, 4, None, None),  # Independence Day
    (11, 11, 1938, 1970),  # Armistice / Veterans Day
    (11, 11, 1978, None),
    (12, 25, None, None),  # Christmas Day
]
# Dates used before the Monday holidays of 1971.
PLAIN_DATES = [
    (2, 22, None, 1970),  # Washington's Birthday
    (5, 30, None, 1970),  # Memorial Day
    (10, 12, 1937, 1970),  # Columbus Day
]
# (month, weekday with Monday = 0, n-th occurrence, first year, last year); n = -1 is the last.
WEEKDAY_RULES = [
    (1, 0, 3, 1986, None),  # Martin Luther King Jr. Day
    (2, 0, 3, 1971, None),  # Washington's Birthday
    (5, 0, -1, 1971, None),  # Memorial Day
    (9, 0, 1, 1894, None),  # Labor Day
    (10, 0, 2, 1971, None),  # Columbus Day
    (10, 0, 4, 1971, 1977),  # Veterans Day
    (11, 3, 4, 1942, None),  # Thanksgiving
]


def _any(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def _in_years(cond: Column, year: Column, first, last) -> Column:
    if first is not None:
        cond = cond & (year >= first)
    if last is not None:
        cond = cond & (year <= last)
    return cond


def _fixed(day: Column, rules) -> Column:
    code, year = F.month(day) * 100 + F.dayofmonth(day), F.year(day)
    return _any([_in_years(code == m * 100 + d, year, a, b) for m, d, a, b in rules])


def _weekday_rule(day: Column) -> Column:
    month, dom, year, dow = F.month(day), F.dayofmonth(day), F.year(day), F.weekday(day)
    terms = []
    for m, wd, n, first, last in WEEKDAY_RULES:
        place = dom > F.dayofmonth(F.last_day(day)) - 7 if n < 0 else dom.between(7 * n - 6, 7 * n)
        terms.append(_in_years((month == m) & (dow == wd) & place, year, first, last))
    return _any(terms)


def is_holiday(day) -> Column:
    """True on a federal holiday or its observed day; false for NULL."""
    day = F.to_date(F.col(day) if isinstance(day, str) else day)
    dow = F.weekday(day)
    hit = (
        _fixed(day, OBSERVED_DATES + PLAIN_DATES)
        | _weekday_rule(day)
        | ((dow == 4) & _fixed(F.date_add(day, 1), OBSERVED_DATES))
        | ((dow == 0) & _fixed(F.date_sub(day, 1), OBSERVED_DATES))
    )
    return F.coalesce(hit, F.lit(False))


def calendar_between(years: DataFrame) -> DataFrame:
    """holiday_date for each row's first_year..last_year; no rows where they are NULL."""
    days = F.sequence(
        F.make_date(F.col("first_year"), F.lit(1), F.lit(1)),
        F.make_date(F.col("last_year"), F.lit(12), F.lit(31)),
    )
    return years.select(F.explode(days).alias("holiday_date")).where(is_holiday("holiday_date"))


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    years = spark.range(1).select(
        F.lit(int(first_year)).alias("first_year"), F.lit(int(last_year)).alias("last_year")
    )
    return calendar_between(years)


def year_range(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """One row: first_year, last_year of a timestamp column."""
    return df.agg(
        F.min(F.year(ts)).alias("first_year"), F.max(F.year(ts)).alias("last_year")
    )


def calendar_of(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Holidays of all years that occur in the data."""
    return calendar_between(year_range(df, ts))


def week_holidays(weeks: DataFrame, label: str = "week_end", ahead: bool = False) -> DataFrame:
    """label, holiday_days: the weeks with holidays among the years of a table of Sunday labels.

    The week ends at its label, or with ahead starts there. The calendar bounds the table: at
    most a dozen rows for each year of the date range, so it is safe to broadcast.
    """
    day = F.col("holiday_date")
    sunday = F.date_sub(day, F.weekday(F.date_add(day, 1))) if ahead else F.date_add(day, 6 - F.weekday(day))
    years = weeks.agg((F.min(F.year(label)) - 1).alias("first_year"), (F.max(F.year(label)) + 1).alias("last_year"))
    return calendar_between(years).groupBy(sunday.alias(label)).agg(F.count(F.lit(1)).alias("holiday_days"))


def add_week_holidays(weeks: DataFrame, known: DataFrame, into: str, label: str = "week_end", ahead: bool = False) -> DataFrame:
    """Adds the number of holidays of each week. known is a stored table with all labels or their span."""
    table = week_holidays(known, label, ahead).withColumnRenamed("holiday_days", "_days")
    joined = weeks.join(F.broadcast(table), label, "left")
    return joined.withColumn(into, F.coalesce("_days", F.lit(0).cast("bigint"))).drop("_days")
