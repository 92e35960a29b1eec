"""Seasonal model per series: differencing, a long autoregression, nonlinear least squares.

The model is the (1,1,1)(1,1,1,s) form with a holiday regressor and its products of regular and
seasonal terms. With w and dx the regular and seasonal differences of the counts and the holiday
days, B the lag and u = w - beta dx,

    (1 - ar B)(1 - sar B^s) u = (1 + ma B)(1 + sma B^s) e.

A long autoregression gives e (Hannan and Rissanen, 1982). The squared error of the second stage
is then a quadratic form in ten lagged columns whose ten weights are products of the five
parameters, so it depends on the data only through the cross-product sums of those columns.
Spark builds these sums for all series in one aggregation; Gauss-Newton steps from the linear
solution then need no further pass. A step is shortened until the error falls, so the result is
never worse than the linear solution it starts from. This is conditional least squares, not exact
maximum likelihood.

Python only solves one small system per series. Every series is one group of at most one row per
calendar week.
"""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweek.schema import SEASON_GRID

# The columns of the second stage and the order of the fitted parameters.
LAG_TERMS = ["w_lag1", "w_lags", "w_lags1", "e_lag1", "e_lags", "e_lags1", "dx", "dx_lag1", "dx_lags", "dx_lags1"]
PARAMETERS = ["ar", "sar", "ma", "sma", "beta"]
# Places in LAG_TERMS of the five columns of the linear start, in the order of the parameters.
LINEAR = [0, 1, 3, 4, 6]
MOST_STEPS = 200
HALVINGS = 12
POLISH = 8
TOLERANCE = 1e-15


def difference(series: DataFrame, keys: list[str], season: int = SEASON_GRID) -> DataFrame:
    """Adds the lags 1, s, s+1 of y, and w and dx, the regular and seasonal differences."""
    w = Window.partitionBy(*keys).orderBy("week_end")
    lagged = series.withColumns(
        {
            "y_lag1": F.lag("y", 1).over(w),
            "y_lags": F.lag("y", season).over(w),
            "y_lags1": F.lag("y", season + 1).over(w),
            "_x1": F.lag("holiday_days", 1).over(w),
            "_xs": F.lag("holiday_days", season).over(w),
            "_xs1": F.lag("holiday_days", season + 1).over(w),
        }
    )
    return lagged.withColumns(
        {
            "w": F.col("y") - F.col("y_lag1") - F.col("y_lags") + F.col("y_lags1"),
            "dx": F.col("holiday_days") - F.col("_x1") - F.col("_xs") + F.col("_xs1"),
        }
    ).drop("_x1", "_xs", "_xs1")


def long_lags(season: int) -> list[int]:
    """Lags of the first-stage autoregression: the last three weeks and the season."""
    return sorted({1, 2, 3, season, season + 1})


def add_lags(df: DataFrame, keys: list[str], column: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("week_end")
    return df.withColumns({f"{column}_{k}": F.lag(column, k).over(w) for k in lags})


def complete_rows(df: DataFrame, terms: list[str], target: str) -> DataFrame:
    """Adds _complete and the doubles _z0, _z1, ... of the terms and the target, zero in incomplete rows."""
    flagged = df.withColumn("_complete", reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*terms, target]]))
    value = lambda c: F.when(F.col("_complete"), F.col(c).cast("double")).otherwise(0.0)
    return flagged.withColumns({f"_z{i}": F.coalesce(value(c), F.lit(0.0)) for i, c in enumerate([*terms, target])})


def product_sums(n_terms: int) -> list[Column]:
    """Aggregates n_obs, xx (the upper triangle of X'X row by row), xy and yy, over complete_rows."""
    total = lambda i, j: F.sum(F.col(f"_z{i}") * F.col(f"_z{j}"))
    return [
        F.count_if("_complete").alias("n_obs"),
        F.array(*[total(i, j) for i in range(n_terms) for j in range(i, n_terms)]).alias("xx"),
        F.array(*[total(i, n_terms) for i in range(n_terms)]).alias("xy"),
        total(n_terms, n_terms).alias("yy"),
    ]


def cross_products(df: DataFrame, keys: list[str], terms: list[str], target: str) -> DataFrame:
    """The sums of each series."""
    return complete_rows(df, terms, target).groupBy(*keys).agg(*product_sums(len(terms)))


def square(upper, terms: int):
    """Full symmetric matrices from their upper triangles, row by row."""
    import numpy as np

    rows, cols = np.triu_indices(terms)
    full = np.zeros((len(upper), terms, terms))
    full[:, rows, cols] = upper
    full[:, cols, rows] = upper
    return full


def minimum_norm(full, right):
    """Minimum-norm solutions of many small symmetric systems, after scaling to a unit diagonal."""
    import numpy as np

    scale = np.sqrt(np.einsum("nii->ni", full))
    scale[~(scale > 0)] = 1.0
    unit = full / (scale[:, :, None] * scale[:, None, :])
    inverse = np.linalg.pinv(unit, rcond=1e-10, hermitian=True)
    return np.einsum("nij,nj->ni", inverse, right / scale) / scale


def solve_least_squares(terms: int):
    """Pandas function from (triangle of X'X, X'y) to the minimum-norm coefficients."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(list(minimum_norm(square(np.stack(xx.to_numpy()), terms), np.stack(xy.to_numpy()))))

    return solve


def lag_weights(p):
    """Weights of LAG_TERMS and their derivatives for rows of parameters."""
    import numpy as np

    ar, sar, ma, sma, beta = p.T
    zero, one = np.zeros_like(ar), np.ones_like(ar)
    weights = [ar, sar, -ar * sar, ma, sma, ma * sma, beta, -beta * ar, -beta * sar, beta * ar * sar]
    slopes = [
        [one, zero, zero, zero, zero],
        [zero, one, zero, zero, zero],
        [-sar, -ar, zero, zero, zero],
        [zero, zero, one, zero, zero],
        [zero, zero, zero, one, zero],
        [zero, zero, sma, ma, zero],
        [zero, zero, zero, zero, one],
        [-beta, zero, zero, zero, -ar],
        [zero, -beta, zero, zero, -sar],
        [beta * sar, beta * ar, zero, zero, ar * sar],
    ]
    return np.stack(weights, axis=1), np.stack([np.stack(r, axis=1) for r in slopes], axis=1)


def squared_error(p, xx, xy, yy):
    import numpy as np

    c, _ = lag_weights(p)
    return yy - 2 * np.einsum("ni,ni->n", c, xy) + np.einsum("ni,nij,nj->n", c, xx, c)


def newton_step(p, xx, xy):
    """Gradients and Newton steps of the squared error, with the curvature of the products."""
    import numpy as np

    c, slopes = lag_weights(p)
    pull = np.einsum("nij,nj->ni", xx, c) - xy
    gradient = np.einsum("nik,ni->nk", slopes, pull)
    curve = np.einsum("nik,nij,njl->nkl", slopes, xx, slopes)
    ar, sar, beta = p[:, 0], p[:, 1], p[:, 4]
    mixed = {
        (0, 1): -pull[:, 2] + beta * pull[:, 9],
        (2, 3): pull[:, 5],
        (0, 4): -pull[:, 7] + sar * pull[:, 9],
        (1, 4): -pull[:, 8] + ar * pull[:, 9],
    }
    for (i, j), v in mixed.items():
        curve[:, i, j] += v
        curve[:, j, i] += v
    return gradient, -minimum_norm(curve, gradient)


def gauss_newton(xx, xy, yy):
    """Parameters and squared errors of many series, and the errors of the linear start.

    Every step is tried at lengths 1, 1/2, 1/4, ...; the one with the least error is taken, until
    no length lowers the error by more than a rounding. There the error is too flat to compare,
    and a few Newton steps follow, each kept only where it shrinks the gradient.
    """
    import numpy as np

    usable = np.isfinite(xx).all(axis=(1, 2)) & np.isfinite(xy).all(axis=1) & np.isfinite(yy)
    p = np.full((len(yy), len(PARAMETERS)), np.nan)
    at = np.flatnonzero(usable)
    p[at] = minimum_norm(xx[at][:, LINEAR][:, :, LINEAR], xy[at][:, LINEAR])
    error = np.full(len(yy), np.nan)
    error[at] = squared_error(p[at], xx[at], xy[at], yy[at])
    start = error.copy()
    lengths = 0.5 ** np.arange(HALVINGS)
    for _ in range(MOST_STEPS):
        if not len(at):
            break
        c, slopes = lag_weights(p[at])
        pull = xy[at] - np.einsum("nij,nj->ni", xx[at], c)
        step = minimum_norm(np.einsum("nik,nij,njl->nkl", slopes, xx[at], slopes), np.einsum("nik,ni->nk", slopes, pull))
        tried = np.stack([squared_error(p[at] + k * step, xx[at], xy[at], yy[at]) for k in lengths], axis=1)
        best = np.nanargmin(np.where(np.isfinite(tried), tried, np.inf), axis=1)
        least = tried[np.arange(len(at)), best]
        better = least < error[at] - TOLERANCE * np.abs(yy[at])
        at, best, least, step = at[better], best[better], least[better], step[better]
        p[at] += lengths[best][:, None] * step
        error[at] = least
    at = np.flatnonzero(usable)
    for _ in range(POLISH if len(at) else 0):
        gradient, step = newton_step(p[at], xx[at], xy[at])
        moved, _ = newton_step(p[at] + step, xx[at], xy[at])
        size = lambda g: np.abs(g).max(axis=1)
        kept = (size(moved) < size(gradient)) & (squared_error(p[at] + step, xx[at], xy[at], yy[at]) <= error[at] + 1e-12 * np.abs(yy[at]))
        at, step = at[kept], step[kept]
        p[at] += step
        if not len(at):
            break
    error[usable] = squared_error(p[usable], xx[usable], xy[usable], yy[usable])
    return p, error, start


def solve_seasonal():
    """Pandas function from (triangle of X'X, X'y, y'y) to the parameters and both squared errors."""

    @F.pandas_udf("coef array<double>, squared_error double, linear_error double")
    def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        import numpy as np

        full = square(np.stack(xx.to_numpy()), len(LAG_TERMS))
        p, error, start = gauss_newton(full, np.stack(xy.to_numpy()), yy.to_numpy(dtype=float))
        return pd.DataFrame({"coef": list(p), "squared_error": error, "linear_error": start})

    return solve


def linear(coefficients: str, terms: list[str]) -> Column:
    parts = [F.element_at(coefficients, i + 1) * F.col(t) for i, t in enumerate(terms)]
    return reduce(lambda a, b: a + b, parts)


def first_stage(series: DataFrame, keys: list[str], season: int) -> tuple[DataFrame, list[str]]:
    """Differenced series with the lags of the long autoregression, and the term names."""
    lags = long_lags(season)
    lagged = add_lags(difference(series, keys, season), keys, "w", lags)
    return lagged, [f"w_{k}" for k in lags] + ["dx"]


def residuals(series: DataFrame, keys: list[str], season: int = SEASON_GRID) -> DataFrame:
    """keys, week_end, y, w, dx and e, the residual of the long autoregression.

    Both sides of the join are already partitioned by the series keys.
    """
    lagged, terms = first_stage(series, keys, season)
    sums = cross_products(lagged, keys, terms, "w")
    fitted = sums.select(*keys, solve_least_squares(len(terms))("xx", "xy").alias("_long"))
    return lagged.join(fitted, keys).select(
        *keys, "week_end", "y", "w", "dx", (F.col("w") - linear("_long", terms)).alias("e")
    )


def second_stage(resid: DataFrame, keys: list[str], season: int) -> DataFrame:
    """The residuals with the lags 1, s and s + 1 of w, e and dx."""
    w = Window.partitionBy(*keys).orderBy("week_end")
    lags = {"lag1": 1, "lags": season, "lags1": season + 1}
    return resid.withColumns({f"{c}_{name}": F.lag(c, k).over(w) for c in ("w", "e", "dx") for name, k in lags.items()})


def _tail(column: str, n: int) -> Column:
    """Last n values of a column in week order, zero where missing."""
    ordered = F.array_sort(
        F.collect_list(F.struct("week_end", F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v")))
    )
    values = F.transform(ordered, lambda r: r["v"])
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def fit_seasonal(
    series: DataFrame, keys: list[str], season: int = SEASON_GRID, min_weeks: int = 0
) -> DataFrame:
    """Parameter table, one row per series.

    coef holds PARAMETERS, squared_error is the error of the fit and linear_error that of its
    start; all are NULL in trend models. model is seasonal where the series has at least as many complete rows as parameters,
    else trend: a straight line over the weeks, or the mean of a single week. status is ok, degenerate
    (nothing is left to explain: the coefficients are zero and the forecast repeats trend and
    season), too_short (fewer than min_weeks weeks), or failed.
    """
    staged = complete_rows(second_stage(residuals(series, keys, season), keys, season), LAG_TERMS, "w")
    week = F.datediff("week_end", F.lit("1970-01-04").cast("date")) / 7
    solved = staged.groupBy(*keys).agg(
        *product_sums(len(LAG_TERMS)),
        F.coalesce(F.regr_slope(F.col("y").cast("double"), week), F.lit(0.0)).alias("trend_slope"),
        F.avg(F.col("y").cast("double")).alias("_mean_y"),
        F.avg(week).alias("_mean_week"),
        F.count(F.lit(1)).alias("n_weeks"),
        F.min("week_end").alias("first_week"),
        F.max("week_end").alias("last_week"),
        _tail("y", season + 1).alias("y_tail"),
        _tail("w", season + 1).alias("w_tail"),
        _tail("e", season + 1).alias("e_tail"),
    )
    solved = solved.withColumn("_fit", solve_seasonal()("xx", "xy", "yy")).select("*", "_fit.*")
    model = F.when(F.col("n_obs") >= len(PARAMETERS), "seasonal").otherwise("trend")
    fitted = {c: F.when(F.col("n_obs") >= len(PARAMETERS), F.col(c)) for c in ("coef", "squared_error", "linear_error")}
    intercept = F.col("_mean_y") - F.col("trend_slope") * F.col("_mean_week")
    finite = ~F.exists("coef", lambda c: c.isNull() | F.isnan(c))
    flat = F.forall("coef", lambda c: c == 0)
    status = (
        F.when(F.col("n_weeks") < min_weeks, "too_short")
        .when(F.col("model") == "trend", "ok")
        .when(~finite, "failed")
        .when(flat, "degenerate")
        .otherwise("ok")
    )
    message = F.when(
        F.col("status") == "too_short",
        F.concat(F.col("n_weeks").cast("string"), F.lit(f" weeks of data, {min_weeks} needed")),
    ).when(F.col("status") == "failed", F.lit("the least-squares system has no finite solution"))
    return (
        solved.withColumns({"model": model, "trend_intercept": intercept} | fitted)
        .withColumn("status", status)
        .withColumn("error_message", message)
        .withColumn("season", F.lit(season))
        .drop("xx", "xy", "yy", "_fit", "_mean_y", "_mean_week")
    )


def training_outcomes(models: DataFrame, keys: list[str]) -> DataFrame:
    """keys, training_successful, error_message."""
    return models.select(
        *keys, F.col("status").isin("ok", "degenerate").alias("training_successful"), "error_message"
    )


def train_each(series: DataFrame, keys: list[str], trainer) -> DataFrame:
    """Run a user's function once per weekly series and report success or its error.

    trainer takes the pandas frame of one series, in week order. An exception becomes a row
    and never fails the job. Only weekly rows reach Python, not incidents.
    """
    fields = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    schema += ", training_successful boolean, error_message string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        try:
            trainer(pdf.sort_values("week_end"))
            out["training_successful"], out["error_message"] = True, None
        except Exception as error:
            out["training_successful"], out["error_message"] = False, str(error)
        return out

    return series.groupBy(*keys).applyInPandas(run, schema)
