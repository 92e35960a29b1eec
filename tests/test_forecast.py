import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweek.functions import holidays
from cellweek.operators import requests, rollout, seasonal
from cellweek.sources.scratch import materialize

START = dt.date(2020, 1, 5)
KEYS = ["key"]


def series(spark, values, holidays=None):
    rows = []
    for key, ys in values.items():
        hs = holidays or [0] * len(ys)
        rows += [(key, START + dt.timedelta(weeks=i), int(y), int(h)) for i, (y, h) in enumerate(zip(ys, hs))]
    return spark.createDataFrame(rows, "key string, week_end date, y long, holiday_days long")


def forecast(models, season, weeks):
    until = F.date_add("last_week", 7 * weeks)
    rows = rollout.forecast_rows(models.withColumn("until", until), KEYS, season, "until")
    return {
        k: list(p.sort_values("week_end").predicted) for k, p in rows.toPandas().groupby("key")
    }


def test_trend_and_season_continue_exactly(spark):
    pattern = [5, 9, 1, 4]
    ys = [3 * i + pattern[i % 4] for i in range(40)]
    models = seasonal.fit_seasonal(series(spark, {"a": ys}), KEYS, 4)
    assert models.first()["status"] == "degenerate"
    assert forecast(models, 4, 6)["a"] == [3 * i + pattern[i % 4] for i in range(40, 46)]


def lag(v, k):
    out = np.full(len(v), np.nan)
    out[k:] = v[:-k]
    return out


def diff(v, s):
    out = np.full(len(v), np.nan)
    out[s + 1 :] = v[s + 1 :] - v[s:-1] - v[1:-s] + v[: -s - 1]
    return out


def least_squares(cols, target):
    m = np.column_stack(cols)
    ok = ~np.isnan(m).any(axis=1) & ~np.isnan(target)
    return np.linalg.lstsq(m[ok], target[ok], rcond=None)[0], m, ok


def second_stage(y, x, s):
    """w, dx, e, the ten lagged columns and their complete rows, written directly for one series."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    w, dx = diff(y, s), diff(x, s)
    beta, m, _ = least_squares([lag(w, k) for k in sorted({1, 2, 3, s, s + 1})] + [dx], w)
    e = w - m @ beta
    z = np.column_stack([lag(w, k) for k in (1, s, s + 1)] + [lag(e, k) for k in (1, s, s + 1)] + [dx] + [lag(dx, k) for k in (1, s, s + 1)])
    return w, dx, e, z, ~np.isnan(z).any(axis=1) & ~np.isnan(w)


def errors(p, w, z, ok):
    ar, sar, ma, sma, beta = p
    c = [ar, sar, -ar * sar, ma, sma, ma * sma, beta, -beta * ar, -beta * sar, beta * ar * sar]
    return w[ok] - z[ok] @ np.array(c)


def roll(coef, y, x, s, steps, future_x):
    """The model's equation, week by week."""
    ar, sar, ma, sma, beta = coef
    w, _, e, _, _ = second_stage(y, x, s)
    ys, ws, es, xs = list(map(float, y)), list(np.nan_to_num(w)), list(np.nan_to_num(e)), list(x) + list(future_x)
    h = diff(np.array(xs, float), s)
    out = []
    for _ in range(steps):
        t = len(ys)
        new = ar * ws[-1] + sar * ws[-s] - ar * sar * ws[-s - 1] + ma * es[-1] + sma * es[-s] + ma * sma * es[-s - 1]
        new += beta * (h[t] - ar * h[t - 1] - sar * h[t - s] + ar * sar * h[t - s - 1])
        level = new + ys[-1] + ys[-s] - ys[-s - 1]
        ys.append(level), ws.append(new), es.append(0.0), out.append(level)
    return out


def week_holidays(spark, n):
    """Holiday days of the Monday-to-Sunday weeks from START on, from the calendar."""
    labels = spark.range(n).select(F.date_add(F.lit(START), (F.col("id") * 7).cast("int")).alias("week_end"))
    rows = holidays.add_week_holidays(labels, labels, "h").orderBy("week_end").collect()
    days = {r.holiday_date for r in holidays.holiday_calendar(spark, 2019, 2024).collect()}
    assert [r.h for r in rows] == [sum(r.week_end - dt.timedelta(k) in days for k in range(7)) for r in rows]
    return [r.h for r in rows]


@pytest.mark.parametrize("season, length", [(4, 140), (13, 200)])
def test_coefficients_and_forecasts_equal_a_direct_computation(spark, season, length):
    rng = np.random.default_rng(1)
    hs = week_holidays(spark, length + 60)
    values = {k: rng.poisson(20 + 5 * np.sin(np.arange(length)), length) for k in "abcd"}
    values["d"] = np.cumsum(rng.normal(0, 2, length)).astype(int) + 60
    models = seasonal.fit_seasonal(series(spark, values, hs[:length]), KEYS, season)
    fits = {r.key: r for r in models.collect()}
    rolled = forecast(models, season, 60)
    for k, ys in values.items():
        w, dx, _, z, ok = second_stage(ys, hs[:length], season)
        p = np.array(fits[k].coef)
        found = errors(p, w, z, ok)
        linear, _, _ = least_squares([z[ok][:, i] for i in seasonal.LINEAR], w[ok])
        start = errors(linear, w, z, ok)
        assert fits[k].n_obs == ok.sum()
        assert np.isclose(fits[k].squared_error, found @ found) and np.isclose(fits[k].linear_error, start @ start)
        assert found @ found <= start @ start * (1 + 1e-9)
        # A least error: its slope vanishes in every direction, and no small change lowers it.
        for i in range(5):
            for h in (1e-4, -1e-4):
                moved = errors(p + h * np.eye(5)[i], w, z, ok)
                assert moved @ moved >= found @ found * (1 - 1e-9)
        assert np.allclose(rolled[k], roll(p, ys, hs[:length], season, 60, hs[length:]), atol=1e-6)


def test_products_recover_a_simulated_model(spark):
    """A long series made by the product form gives its parameters back."""
    rng = np.random.default_rng(3)
    ar, sar, s, n = 0.6, -0.5, 4, 3000
    e, w = rng.normal(0, 30, n), np.zeros(n)
    for t in range(s + 1, n):
        w[t] = ar * w[t - 1] + sar * w[t - s] - ar * sar * w[t - s - 1] + e[t]
    y = np.zeros(n)
    for t in range(n):
        y[t] = w[t] + (y[t - 1] if t else 0) + (y[t - s] if t >= s else 0) - (y[t - s - 1] if t > s else 0)
    fit = seasonal.fit_seasonal(series(spark, {"a": np.round(y)}), KEYS, s).first()
    assert np.allclose(fit.coef[:4], [ar, sar, 0, 0], atol=0.1)
    assert fit.squared_error <= fit.linear_error


def test_blocks_do_not_depend_on_the_horizon_and_cost_grows_with_it(spark):
    rng = np.random.default_rng(4)
    models = materialize(seasonal.fit_seasonal(series(spark, {k: rng.poisson(9, 90) for k in "abc"}), KEYS, 4))
    short, long = forecast(models, 4, 7), forecast(models, 4, 301)
    assert all(np.allclose(long[k][:7], short[k]) and len(long[k]) == 301 for k in short)

    def seconds(weeks):
        until = models.withColumn("until", F.date_add("last_week", 7 * weeks))
        start = time.perf_counter()
        assert rollout.forecast_rows(until, KEYS, 4, "until").count() == 3 * weeks
        return time.perf_counter() - start

    seconds(100)
    assert seconds(6400) < 5 * max(seconds(1600), 0.2)


def test_short_series_follow_their_trend(spark):
    lengths = [1, 2, 30, 54, 100, 158, 159, 170]
    made = series(spark, {str(n): [3 * i + 2 for i in range(n)] for n in lengths})
    models = seasonal.fit_seasonal(made, KEYS, 52)
    got = {int(r.key): r for r in models.collect()}
    assert {n: r.model for n, r in got.items()} == {n: "seasonal" if r.n_obs >= 5 else "trend" for n, r in got.items()}
    assert got[159].model == "trend" and got[170].model == "seasonal"
    assert all(r.training_successful for r in seasonal.training_outcomes(models, KEYS).collect())
    ahead = forecast(models.where("model = 'trend'"), 52, 3)
    for n in lengths[1:7]:
        assert np.allclose(ahead[str(n)], [3 * i + 2 for i in range(n, n + 3)])
    assert np.allclose(ahead["1"], [2, 2, 2])


def test_short_series_are_reported(spark):
    models = seasonal.fit_seasonal(series(spark, {"a": [1, 2, 3], "b": [1] * 30}), KEYS, 4, min_weeks=20)
    got = {r.key: r for r in seasonal.training_outcomes(models, KEYS).collect()}
    assert not got["a"].training_successful and got["a"].error_message == "3 weeks of data, 20 needed"
    assert got["b"].training_successful and got["b"].error_message is None
    assert rollout.trained(models).count() == 1


def test_a_failing_trainer_becomes_a_row(spark):
    def trainer(pdf: pd.DataFrame):
        assert list(pdf.week_end) == sorted(pdf.week_end)
        if pdf.y.sum() > 10:
            raise RuntimeError("too many")

    got = seasonal.train_each(series(spark, {"a": [1, 2, 3], "b": [10, 20]}), KEYS, trainer)
    assert {r.key: (r.training_successful, r.error_message) for r in got.collect()} == {
        "a": (True, None),
        "b": (False, "too many"),
    }


def ask(spark, rows):
    return spark.createDataFrame(rows, "request_id int, key string, start_date date, end_date date")


def test_request_outcomes_and_reports(spark):
    ys = [3 * i + [5, 9, 1, 4][i % 4] for i in range(40)]
    models = seasonal.fit_seasonal(series(spark, {"7": ys}), KEYS, 4)
    last = START + dt.timedelta(weeks=39)
    day = lambda n: last + dt.timedelta(days=n)
    asked = ask(
        spark,
        [
            (1, "7", day(7), day(21)),
            (2, "x", day(7), day(21)),
            (3, "7", day(21), day(7)),
            (4, "7", day(-30), day(-1)),
            (5, "7", day(8), day(12)),
            (6, "7", None, day(21)),
            (7, "7", day(-30), day(20)),
            (8, "7", day(-3), day(0)),
        ],
    )
    today = F.lit(day(1)).cast("date")
    sliced = requests.request_forecasts(asked, models, KEYS, 4, today)
    got = {r.request_id: (r.status, r.code) for r in sliced.collect()}
    assert got == {
        1: ("ok", 200),
        2: ("not_found", 404),
        3: ("start_after_end", 400),
        4: ("end_before_training", 400),
        5: ("empty_slice", 400),
        6: ("ok", 200),
        7: ("ok", 200),
        8: ("end_before_training", 400),
    }
    reports = {r.request_id: r for r in requests.forecast_reports(sliced, "key").collect()}
    expected = [3 * i + [5, 9, 1, 4][i % 4] for i in range(40, 44)]
    assert [b.predicted_crimes for b in reports[1].forecast_breakdown] == expected[:3]
    assert reports[1].total_predicted_crimes == sum(expected[:3])
    assert reports[1].hotspot_id == 7
    assert (reports[1].forecast_period.start, reports[1].forecast_period.end) == (str(day(7)), str(day(21)))
    assert [b.date for b in reports[6].forecast_breakdown] == [str(day(7 * k)) for k in (1, 2, 3, 4)]
    assert [b.predicted_crimes for b in reports[7].forecast_breakdown] == expected[:2]
