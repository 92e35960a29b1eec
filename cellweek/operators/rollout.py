"""Forecasts from the parameter table, by a linear recurrence that advances one season per step.

All weeks of a block refer back to the block before it and to their own left neighbour, so a
task holds one season per series, whatever the horizon, and emits every block as a row of its
own. Series of one Arrow batch advance together.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweek.functions.holidays import holiday_calendar
from cellweek.functions.scalars import weeks_between

# Fixed value: days from 1970-01-01 to the first Sunday, where week 0 ends.
FIRST_SUNDAY = 3


def trained(models: DataFrame) -> DataFrame:
    return models.where(F.col("status").isin("ok", "degenerate"))


class WeekCalendar:
    """Holidays by week number: of the week that ends at the label, and of the seven days from it on."""

    def __init__(self, days: list[int], first: int, last: int):
        import numpy as np

        days = np.array(days, np.int64) - FIRST_SUNDAY
        self.first = first
        ending, ahead = -(-days // 7) - first, days // 7 - first
        size = last - first + 1
        self.days = np.bincount(ending[(ending >= 0) & (ending < size)], minlength=size).astype(float)
        self.ahead = np.bincount(ahead[(ahead >= 0) & (ahead < size)], minlength=size)

    def differenced(self, season: int):
        """Regular and seasonal difference of days; the first season + 1 weeks have none."""
        import numpy as np

        out = np.zeros_like(self.days)
        out[season + 1 :] = self.days[season + 1 :] - self.days[season:-1] - self.days[1:-season] + self.days[: -season - 1]
        return out


def week_calendar(models: DataFrame, season: int) -> WeekCalendar | None:
    """Holidays of all weeks that the forecasts of these models refer to; None without models.

    Its length is bounded by the range of dates, whatever the number of series.
    """
    week = (F.datediff("last_week", F.lit("1970-01-04").cast("date")) / 7).cast("bigint")
    span = models.agg(F.min(week).alias("first"), F.max(week + F.col("_steps")).alias("last")).first()
    if span["first"] is None:
        return None
    first, last = span["first"] - 2 * (season + 1) - 1, span["last"] + 1
    years = [1970 + int(w * 7 / 365.25) + d for w, d in ((first, -2), (last, 2))]
    rows = holiday_calendar(models.sparkSession, max(1, years[0]), min(9999, years[1]))
    days = [r["d"] for r in rows.select(F.unix_date("holiday_date").alias("d")).collect()]
    return WeekCalendar(days, first, last)


def season_block(p, y, w, e, dx, start, season: int):
    """The next season of every series: levels and differences.

    p holds rows of parameters; y, w and e the last season + 1 levels, differences and residuals;
    start is the place in dx of the block's first week. Future residuals are zero.
    """
    import numpy as np

    ar, sar, ma, sma, beta = (c[:, None] for c in p.T)
    at = start[:, None] + np.arange(season)
    known = sar * w[:, 1:] - ar * sar * w[:, :-1] + sma * e[:, 1:] + ma * sma * e[:, :-1]
    known += beta * (dx[at] - ar * dx[at - 1] - sar * dx[at - season] + ar * sar * dx[at - season - 1])
    known[:, 0] += p[:, 2] * e[:, -1]
    new = np.empty_like(known)
    before = w[:, -1]
    for i in range(season):
        before = known[:, i] + p[:, 0] * before
        new[:, i] = before
    return y[:, -1:] + np.cumsum(new + y[:, 1:] - y[:, :-1], axis=1), new


def forecast_blocks(models: DataFrame, keys: list[str], season: int, until: str) -> DataFrame:
    """keys, block, first_week, predicted, holiday_count: arrays of one season of weeks.

    Blocks count from 0 at the first week after the series and end in the week of the date column
    until. Series whose last week is not before that week give no row.
    """
    steps = weeks_between(until, "last_week")
    source = (
        trained(models)
        .withColumn("_steps", steps)
        .where(F.col("_steps") > 0)
        .select(*keys, "last_week", "_steps", "model", "coef", "trend_slope", "trend_intercept", "y_tail", "w_tail", "e_tail")
    )
    calendar = week_calendar(source, season)
    spark = models.sparkSession
    fields = [source.schema[k] for k in keys] + [
        T.StructField("block", T.LongType()),
        T.StructField("first_week", T.DateType()),
        T.StructField("predicted", T.ArrayType(T.DoubleType())),
        T.StructField("holiday_count", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType(fields)
    if calendar is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(calendar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weeks = shared.value
        dx = weeks.differenced(season)

        def tails(column: pa.Array):
            out = np.zeros((len(column), season + 1))
            for i, v in enumerate(column.to_pylist()):
                v = (v or [])[-(season + 1) :]
                out[i, season + 1 - len(v) :] = v
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            left = named["_steps"].to_numpy(zero_copy_only=False).astype(np.int64)
            last = named["last_week"].cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
            number = (last - FIRST_SUNDAY) // 7 + 1
            line = np.array([m == "trend" for m in named["model"].to_pylist()])
            slope = named["trend_slope"].to_numpy(zero_copy_only=False)
            origin = named["trend_intercept"].to_numpy(zero_copy_only=False)
            p = np.array([c if c is not None and len(c) == 5 else [0.0] * 5 for c in named["coef"].to_pylist()])
            y, w, e = (tails(named[c]) for c in ("y_tail", "w_tail", "e_tail"))
            alive, block = np.arange(batch.num_rows), 0
            while len(alive):
                width = np.minimum(left[alive], season)
                at = np.minimum((number[alive] - weeks.first)[:, None] + np.arange(season), len(weeks.days) - 1)
                levels, new = season_block(p[alive], y[alive], w[alive], e[alive], np.append(dx, np.zeros(season)), at[:, 0], season)
                straight = origin[alive][:, None] + slope[alive][:, None] * (number[alive][:, None] + np.arange(season))
                shown = np.where(line[alive][:, None], straight, levels)
                inside = np.arange(season) < width[:, None]
                ends = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
                columns = [named[k].take(pa.array(alive)) for k in keys]
                columns += [
                    pa.array(np.full(len(alive), block, np.int64)),
                    pa.array((number[alive] * 7 + FIRST_SUNDAY).astype(np.int32)).cast(pa.date32()),
                    pa.ListArray.from_arrays(ends, pa.array(shown[inside])),
                    pa.ListArray.from_arrays(ends, pa.array(weeks.ahead[at][inside].astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
                y[alive] = np.concatenate([y[alive][:, -1:], levels], axis=1)
                w[alive] = np.concatenate([w[alive][:, -1:], new], axis=1)
                e[alive] = np.concatenate([e[alive][:, -1:], np.zeros_like(new)], axis=1)
                left[alive] -= season
                number[alive] += season
                block += 1
                alive = alive[left[alive] > 0]

    return source.mapInArrow(run, schema)


def forecast_rows(models: DataFrame, keys: list[str], season: int, until: str) -> DataFrame:
    """keys, week_end, predicted, holiday_count, is_holiday_week: one row per future week."""
    blocks = forecast_blocks(models, keys, season, until)
    weeks = blocks.select(*keys, "first_week", F.posexplode(F.arrays_zip("predicted", "holiday_count")).alias("_place", "_week"))
    return weeks.select(
        *keys,
        F.date_add("first_week", 7 * F.col("_place")).alias("week_end"),
        F.col("_week.predicted").alias("predicted"),
        F.col("_week.holiday_count").alias("holiday_count"),
        (F.col("_week.holiday_count") > 0).alias("is_holiday_week"),
    )


def future_weeks(spans: DataFrame, keys: list[str], until: str) -> DataFrame:
    """The week labels after each series up to a date column."""
    steps = weeks_between(until, "last_week")
    last = F.date_add(F.col("last_week"), (7 * steps).cast("int"))
    return spans.where(steps > 0).select(
        *keys, F.explode(F.sequence(F.date_add("last_week", 7), last, F.expr("interval 7 days"))).alias("week_end")
    )
