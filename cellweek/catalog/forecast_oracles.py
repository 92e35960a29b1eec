"""SQL twins of the fitted models and their forecasts.

The parameters come from plain Gauss-Newton steps, the forecasts from the model's equation week
by week, both as recursive queries; the engine's own way is damped, polished and in blocks.
"""

from cellweek.catalog.oracles import AHEAD, DIFFERENCED, HOTSPOTS, NAMED, REQUESTS, SERIES, SPANS

KEY = "hotspot_id_x, hotspot_id_y"
STEPS = 100


def _solved(matrix: str, n: int) -> str:
    """Solution of an augmented system, by elimination with the diagonal as pivots."""
    step = (
        f"list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 2}), lambda j: "
        "CASE WHEN i = k[1][1] THEN a[i][j] / a[i][i] "
        "ELSE a[i][j] - a[i][CAST(k[1][1] AS INTEGER)] * a[CAST(k[1][1] AS INTEGER)][j] "
        "/ a[CAST(k[1][1] AS INTEGER)][CAST(k[1][1] AS INTEGER)] END))"
    )
    pivots = ", ".join(f"[[CAST({k} AS DOUBLE)]]" for k in range(1, n + 1))
    reduced = f"list_reduce([{matrix}, {pivots}], lambda a, k: {step})"
    return f"list_transform({reduced}, lambda r: r[{n + 1}])"


def _sum(a: str, b: str) -> str:
    return f"CAST(sum({a} * {b}) AS DOUBLE)"


def _augmented(terms: list[str], target: str) -> str:
    rows = ["[" + ", ".join(_sum(a, b) for b in [*terms, target]) + "]" for a in terms]
    return "[" + ", ".join(rows) + "]"


_LONG = ["t1", "t2", "t3", "t52", "t53", "dx"]
_LAGS = [f"{c}{k}" for c in ("w", "e") for k in (1, 52, 53)] + ["dx", "dx1", "dx52", "dx53"]
_LINEAR = ["w1", "w52", "e1", "e52", "dx"]
_WEIGHTS = "[p[1], p[2], -p[1] * p[2], p[3], p[4], p[3] * p[4], p[5], -p[5] * p[1], -p[5] * p[2], p[5] * p[1] * p[2]]"
_SLOPES = """[[1.0, 0, 0, 0, 0], [0.0, 1, 0, 0, 0], [-p[2], -p[1], 0, 0, 0], [0.0, 0, 1, 0, 0], [0.0, 0, 0, 1, 0],
  [0.0, 0, p[4], p[3], 0], [0.0, 0, 0, 0, 1], [-p[5], 0, 0, 0, -p[1]], [0.0, -p[5], 0, 0, -p[2]],
  [p[5] * p[2], p[5] * p[1], 0, 0, p[1] * p[2]]]"""

MODELS = (
    DIFFERENCED
    + SPANS[len(SERIES) :]
    + f""",
long_lags AS (
  SELECT {KEY}, week_end, y, CAST(w AS DOUBLE) AS w, CAST(dx AS DOUBLE) AS dx,
         {", ".join(f"CAST(lag(w, {k}) OVER s AS DOUBLE) AS t{k}" for k in (1, 2, 3, 52, 53))}
  FROM differenced WINDOW s AS (PARTITION BY {KEY} ORDER BY week_end)
),
long_sums AS (
  SELECT {KEY}, {_augmented(_LONG, "w")} AS m FROM long_lags WHERE t53 IS NOT NULL GROUP BY {KEY}
),
long_fit AS MATERIALIZED (SELECT {KEY}, {_solved("m", 6)} AS b FROM long_sums),
resid AS MATERIALIZED (
  SELECT {KEY}, week_end, y, w, dx, w - ({" + ".join(f"b[{i + 1}] * {t}" for i, t in enumerate(_LONG))}) AS e
  FROM long_lags LEFT JOIN long_fit USING ({KEY})
),
lags AS (
  SELECT {KEY}, week_end, w, dx,
         {", ".join(f"lag({c}, {k}) OVER s AS {c}{k}" for c in ("w", "e", "dx") for k in (1, 52, 53))}
  FROM resid WINDOW s AS (PARTITION BY {KEY} ORDER BY week_end)
),
sums AS MATERIALIZED (
  SELECT {KEY}, count(*) AS n_obs, {_augmented(_LAGS, "w")} AS m, {_augmented(_LINEAR, "w")} AS linear, {_sum("w", "w")} AS yy
  FROM lags WHERE e53 IS NOT NULL GROUP BY {KEY} HAVING count(*) >= 5
),
steps AS (
  SELECT {KEY}, 0 AS step, {_solved("linear", 5)} AS p, m FROM sums
  UNION ALL
  SELECT {KEY}, step + 1, list_transform(range(1, 6), lambda k: p[k] + d[k]), m FROM (
    SELECT {KEY}, step, p, m, {_solved("a", 5)} AS d FROM (
      SELECT {KEY}, step, p, m, list_transform(range(1, 6), lambda k: list_concat(
          list_transform(range(1, 6), lambda l: list_sum(list_transform(range(1, 11), lambda i: j[i][k] * mj[i][l]))),
          [list_sum(list_transform(range(1, 11), lambda i: j[i][k] * pull[i]))])) AS a
      FROM (
        SELECT *, list_transform(range(1, 11), lambda i: m[i][11] - list_sum(list_transform(range(1, 11), lambda o: m[i][o] * c[o]))) AS pull,
               list_transform(range(1, 11), lambda i: list_transform(range(1, 6), lambda l:
                 list_sum(list_transform(range(1, 11), lambda o: m[i][o] * j[o][l])))) AS mj
        FROM (SELECT *, {_WEIGHTS} AS c, {_SLOPES} AS j FROM steps WHERE step < {STEPS})
      )
    )
  )
),
coefs AS (SELECT {KEY}, p FROM steps WHERE step = {STEPS}),
tails AS (
  SELECT {KEY}, list(CAST(y AS DOUBLE) ORDER BY week_end)[-53:] AS ys, list(coalesce(w, 0) ORDER BY week_end)[-53:] AS ws,
         list(coalesce(e, 0) ORDER BY week_end)[-53:] AS es,
         regr_slope(y, date_diff('day', DATE '1970-01-04', week_end) / 7) AS slope,
         regr_intercept(y, date_diff('day', DATE '1970-01-04', week_end) / 7) AS origin
  FROM resid GROUP BY {KEY}
),
models AS MATERIALIZED (SELECT * FROM spans JOIN tails USING ({KEY}) LEFT JOIN coefs USING ({KEY}) LEFT JOIN (SELECT {KEY}, n_obs FROM sums) USING ({KEY}))"""
)


def _forecasts(until: str) -> str:
    """CTE forecasts(keys, week_end, predicted) to the week of a date, one series of lists per step."""
    return f""",
every_week AS (
  SELECT CAST(unnest(generate_series(DATE '1990-12-30', DATE '2029-12-30', INTERVAL 7 DAY)) AS DATE) AS week_end
),
week_days AS (SELECT week_end, coalesce(n, 0) AS d FROM every_week LEFT JOIN holiday_weeks USING (week_end)),
week_dx AS (
  SELECT week_end, d - lag(d, 1) OVER s - lag(d, 52) OVER s + lag(d, 53) OVER s AS h FROM week_days WINDOW s AS (ORDER BY week_end)
),
week_terms AS MATERIALIZED (
  SELECT week_end, CAST(h AS DOUBLE) AS h, lag(h, 1) OVER s AS h1, lag(h, 52) OVER s AS h52, lag(h, 53) OVER s AS h53
  FROM week_dx WINDOW s AS (ORDER BY week_end)
),
rolled AS (
  SELECT {KEY}, last_week AS week_end, ys, ws, es, p FROM models WHERE p IS NOT NULL
  UNION ALL
  SELECT {KEY}, week_end, list_append(ys[2:], w + ys[53] + ys[2] - ys[1]), list_append(ws[2:], w),
         list_append(es[2:], CAST(0 AS DOUBLE)), p
  FROM (
    SELECT r.hotspot_id_x, r.hotspot_id_y, t.week_end, ys, ws, es, p,
           p[1] * ws[53] + p[2] * ws[2] - p[1] * p[2] * ws[1] + p[3] * es[53] + p[4] * es[2] + p[3] * p[4] * es[1]
           + p[5] * (h - p[1] * h1 - p[2] * h52 + p[1] * p[2] * h53) AS w
    FROM rolled r JOIN week_terms t ON t.week_end = r.week_end + 7 WHERE r.week_end + 7 <= {until}
  )
),
forecasts AS MATERIALIZED (
  SELECT {KEY}, r.week_end, r.ys[53] AS predicted FROM rolled r JOIN spans USING ({KEY}) WHERE r.week_end > last_week
  UNION ALL
  SELECT {KEY}, t.week_end, origin + slope * (date_diff('day', DATE '1970-01-04', t.week_end) / 7)
  FROM models JOIN week_terms t ON t.week_end > last_week AND t.week_end <= {until} WHERE p IS NULL
)"""


_REQUESTS = MODELS + REQUESTS[len(SPANS) :]
_LAST = "(SELECT max(end_week) FROM resolved WHERE status = 'ok')"
REPORTS = (
    _REQUESTS
    + ","
    + AHEAD
    + _forecasts(_LAST)
    + NAMED[len(HOTSPOTS) :]
    + f""",
lines AS (
  SELECT request_id, {KEY}, f.week_end, f.predicted, coalesce(n, 0) > 0 AS is_holiday_week, first_label, last_label
  FROM resolved JOIN forecasts f USING ({KEY}) LEFT JOIN ahead_weeks a ON a.week_end = f.week_end
  WHERE status = 'ok' AND f.week_end BETWEEN first_label AND last_label
),
totals AS (SELECT request_id, round_even(sum(predicted ORDER BY week_end) * 100, 0) / 100 AS total FROM lines GROUP BY request_id)"""
)
_REPORT = f"""WITH RECURSIVE {REPORTS}
    SELECT request_id, id AS hotspot_id, strftime(first_label, '%Y-%m-%d') AS period_start, strftime(last_label, '%Y-%m-%d') AS period_end,
           total AS total_predicted_crimes, strftime(week_end, '%Y-%m-%d') AS date,
           round_even(predicted * 100, 0) / 100 AS predicted_crimes, is_holiday_week
    FROM lines JOIN totals USING (request_id) JOIN named USING ({KEY})"""

FORECAST_ORACLES = {
    "fit_seasonal": f"""WITH RECURSIVE {MODELS}
        SELECT {KEY}, 'ok' AS status, n_weeks, n_obs, last_week, CAST(term AS INTEGER) AS term, round(p[term + 1], 6) AS value
        FROM (SELECT *, unnest(range(0, 5)) AS term FROM models WHERE p IS NOT NULL)""",
    "seasonal_errors": f"""WITH RECURSIVE {MODELS},
        weighted AS (SELECT {KEY}, step, {_WEIGHTS} AS c FROM steps WHERE step IN (0, {STEPS})),
        errors AS (
          SELECT {KEY}, n_obs, step, yy + list_sum(list_transform(range(1, 11), lambda i: c[i] * (
                 list_sum(list_transform(range(1, 11), lambda j: m[i][j] * c[j])) - 2 * m[i][11]))) AS error
          FROM sums JOIN weighted USING ({KEY}))
        SELECT {KEY}, n_obs, round(min(error) FILTER (WHERE step = {STEPS}), 6) AS squared_error,
               min(error) FILTER (WHERE step = {STEPS}) <= min(error) FILTER (WHERE step = 0) AS not_worse
        FROM errors GROUP BY {KEY}, n_obs""",
    "forecast_weeks": f"""WITH RECURSIVE {MODELS},{AHEAD}{_forecasts("DATE '2002-01-06'")}
        SELECT {KEY}, f.week_end, round(predicted, 6) AS predicted, coalesce(n, 0) AS holiday_count, coalesce(n, 0) > 0 AS is_holiday_week
        FROM forecasts f LEFT JOIN ahead_weeks a ON a.week_end = f.week_end""",
    "forecast_report": _REPORT,
    "forecast_report_json": _REPORT,
    "forecast_report_weeks": f"""WITH RECURSIVE {REPORTS}
        SELECT request_id, strftime(week_end, '%Y-%m-%d') AS date, is_holiday_week,
               CAST(floor(total) AS BIGINT) AS total_shown, CAST(floor(round_even(predicted * 100, 0) / 100) AS BIGINT) AS shown
        FROM lines JOIN totals USING (request_id)""",
    "forecast_by_id": f"""WITH RECURSIVE {MODELS}{_forecasts("DATE '2002-05-05'")},
        named AS (SELECT *, ((hotspot_id_x + hotspot_id_y) % 5 + 5) % 5 AS short_id FROM spans),
        sums_ahead AS (
          SELECT {KEY}, count(*) AS n, round(sum(predicted), 6) AS total FROM forecasts
          WHERE week_end BETWEEN DATE '2002-03-01' AND DATE '2002-04-30' GROUP BY {KEY})
        SELECT c_custkey AS request_id, c_custkey % 7 AS short_id, named.hotspot_id_x, named.hotspot_id_y,
               CASE WHEN last_week IS NULL THEN 'not_found' ELSE 'ok' END AS status, coalesce(n, 0) AS n_weeks, total
        FROM customer LEFT JOIN named ON short_id = c_custkey % 7
             LEFT JOIN sums_ahead s ON s.hotspot_id_x = named.hotspot_id_x AND s.hotspot_id_y = named.hotspot_id_y""",
    "model_lookup": f"""WITH RECURSIVE {MODELS}
        SELECT {KEY}, n_weeks, last_week, round(p[1], 6) AS ar, round(p[2], 6) AS sar FROM models
        ORDER BY {KEY} LIMIT 1""",
}
