"""SQL twins of the registered queries, written for DuckDB over the whole test tables."""

PLACED = """
placed AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice, c_mktsegment,
         CAST(-87.9 AS DOUBLE) + c_nationkey * CAST(0.001 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS lon,
         CAST(41.6 AS DOUBLE) + floor(c_acctbal / 1000) * CAST(0.001 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS lat
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

INCIDENTS = PLACED + """,
incidents AS (
  SELECT o_orderkey AS id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day,
         CAST(floor(lon / CAST(0.001 AS DOUBLE)) AS BIGINT) AS grid_x,
         CAST(floor(lat / CAST(0.001 AS DOUBLE)) AS BIGINT) AS grid_y
  FROM placed
)"""

RAW = PLACED + """,
timed AS (
  SELECT *, date_trunc('day', o_orderdate)
            + to_seconds(CAST(floor(o_totalprice * 100) AS BIGINT) % 86400) AS ts
  FROM placed
),
raw AS (
  SELECT o_orderkey AS id, 'C' || o_orderkey AS case_number,
         CASE WHEN o_totalprice < 6000 THEN NULL
              WHEN o_totalprice < 12000 THEN 'unknown'
              WHEN o_totalprice < 60000 THEN strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')
              ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS date_text,
         c_mktsegment AS block, o_orderpriority AS primary_type,
         CASE WHEN o_totalprice BETWEEN 486000 AND 490000 THEN NULL
              ELSE floor(o_totalprice) END AS x,
         floor(o_totalprice) AS y,
         CASE WHEN o_totalprice > 497000 THEN NULL WHEN o_totalprice > 494000 THEN 0
              WHEN o_totalprice BETWEEN 300000 AND 310000 THEN 'nan'::DOUBLE ELSE lat END AS latitude,
         CASE WHEN o_totalprice BETWEEN 490000 AND 494000 THEN 0 ELSE lon END AS longitude,
         '(' || c_mktsegment || ', ' || o_orderstatus || ')' AS location
  FROM timed
),
parsed AS (
  SELECT *, try_strptime(date_text, '%m/%d/%Y %I:%M:%S %p') AS ts FROM raw
)"""


def _holidays(years: str) -> str:
    """CTE holidays(holiday_date) for the years first_year..last_year of a one-row relation."""
    return f"""
span AS ({years}),
years AS (SELECT unnest(range(first_year - 1, last_year + 2)) AS y, first_year, last_year FROM span),
fixed(m, d, a, b, observed) AS (VALUES
  (1, 1, 0, 9999, true), (6, 19, 2021, 9999, true), (7, 4, 0, 9999, true),
  (11, 11, 1938, 1970, true), (11, 11, 1978, 9999, true), (12, 25, 0, 9999, true),
  (2, 22, 0, 1970, false), (5, 30, 0, 1970, false), (10, 12, 1937, 1970, false)),
nth(m, dow, n, a, b) AS (VALUES
  (1, 1, 3, 1986, 9999), (2, 1, 3, 1971, 9999), (9, 1, 1, 1894, 9999), (10, 1, 2, 1971, 9999),
  (10, 1, 4, 1971, 1977), (11, 4, 4, 1942, 9999)),
actual AS (
  SELECT CAST(make_date(y, m, d) AS DATE) AS day, observed FROM years, fixed WHERE y BETWEEN a AND b
  UNION ALL
  SELECT CAST(make_date(y, m, 1) AS DATE)
         + CAST((dow - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER), false
  FROM years, nth WHERE y BETWEEN a AND b
  UNION ALL
  SELECT make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1) % 7 AS INTEGER), false
  FROM years WHERE y >= 1971
),
all_days AS (
  SELECT day FROM actual
  UNION
  SELECT CASE WHEN isodow(day) = 6 THEN day - 1 ELSE day + 1 END
  FROM actual WHERE observed AND isodow(day) IN (6, 7)
),
holidays AS (
  SELECT day AS holiday_date FROM all_days, span WHERE year(day) BETWEEN first_year AND last_year
)"""


DATA_YEARS = "SELECT min(year(ts)) AS first_year, max(year(ts)) AS last_year FROM incidents"
WIDE_YEARS = "SELECT 1990 AS first_year, 2030 AS last_year"

HOTSPOTS = INCIDENTS + """,
cells AS (SELECT grid_x, grid_y, count(*) AS crime_count FROM incidents GROUP BY ALL),
hotspots AS (
  SELECT grid_x AS hotspot_id_x, grid_y AS hotspot_id_y, crime_count FROM cells
  WHERE crime_count > (SELECT quantile_disc(crime_count, 0.95) FROM cells)
)"""


def _series(cells: str) -> str:
    """CTE series(hotspot_id_x, hotspot_id_y, week_end, y, holiday_incidents, holiday_days)."""
    return _holidays(WIDE_YEARS) + f""",
members AS (
  SELECT i.grid_x AS hotspot_id_x, i.grid_y AS hotspot_id_y,
         CAST(date_trunc('week', i.ts) AS DATE) + 6 AS week_end,
         i.day IN (SELECT holiday_date FROM holidays) AS is_holiday
  FROM incidents i JOIN {cells} h ON i.grid_x = h.hotspot_id_x AND i.grid_y = h.hotspot_id_y
),
weekly AS (
  SELECT hotspot_id_x, hotspot_id_y, week_end, count(*) AS y,
         count(*) FILTER (WHERE is_holiday) AS holiday_incidents
  FROM members GROUP BY ALL
),
spine AS (
  SELECT hotspot_id_x, hotspot_id_y,
         CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM weekly GROUP BY hotspot_id_x, hotspot_id_y
),
holiday_weeks AS (
  SELECT CAST(date_trunc('week', holiday_date) AS DATE) + 6 AS week_end, count(*) AS n
  FROM holidays GROUP BY 1
),
series AS (
  SELECT s.hotspot_id_x, s.hotspot_id_y, s.week_end, coalesce(w.y, 0) AS y,
         coalesce(w.holiday_incidents, 0) AS holiday_incidents, coalesce(h.n, 0) AS holiday_days
  FROM spine s LEFT JOIN weekly w USING (hotspot_id_x, hotspot_id_y, week_end)
       LEFT JOIN holiday_weeks h ON h.week_end = s.week_end
)"""


SERIES = HOTSPOTS + "," + _series("hotspots")
ALL_CELLS = (
    INCIDENTS
    + """,
every_cell AS (SELECT DISTINCT grid_x AS hotspot_id_x, grid_y AS hotspot_id_y FROM incidents),"""
    + _series("every_cell")
)

DIFFERENCED = SERIES + """,
lagged AS (
  SELECT *, lag(y, 1) OVER s AS y_lag1, lag(y, 52) OVER s AS y_lags, lag(y, 53) OVER s AS y_lags1,
         holiday_days - lag(holiday_days, 1) OVER s - lag(holiday_days, 52) OVER s
           + lag(holiday_days, 53) OVER s AS dx
  FROM series WINDOW s AS (PARTITION BY hotspot_id_x, hotspot_id_y ORDER BY week_end)
),
differenced AS (
  SELECT hotspot_id_x, hotspot_id_y, week_end, y, y_lag1, y_lags, y_lags1,
         y - y_lag1 - y_lags + y_lags1 AS w, dx
  FROM lagged
)"""

SPANS = SERIES + """,
spans AS (
  SELECT hotspot_id_x, hotspot_id_y, min(week_end) AS first_week, max(week_end) AS last_week,
         count(*) AS n_weeks
  FROM series GROUP BY ALL
)"""

AHEAD = """
ahead_weeks AS (
  SELECT holiday_date - CAST(isodow(holiday_date) % 7 AS INTEGER) AS week_end, count(*) AS n
  FROM holidays GROUP BY 1
)"""

REQUESTS = SPANS + """,
asked AS (
  SELECT c_custkey AS request_id,
         CAST(floor((CAST(-87.9 AS DOUBLE) + c_nationkey * CAST(0.001 AS DOUBLE) + CAST(0.0005 AS DOUBLE))
              / CAST(0.001 AS DOUBLE)) AS BIGINT) AS hotspot_id_x,
         CAST(floor((CAST(41.6 AS DOUBLE) + floor(c_acctbal / 1000) * CAST(0.001 AS DOUBLE)
              + CAST(0.0005 AS DOUBLE)) / CAST(0.001 AS DOUBLE)) AS BIGINT) AS hotspot_id_y,
         DATE '2001-06-01' + CAST(trunc(c_acctbal / 40) AS INTEGER) AS s,
         c_nationkey * 4 - 8 AS n, c_mktsegment
  FROM customer
),
windows AS (
  SELECT request_id, hotspot_id_x, hotspot_id_y,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN DATE '2001-08-15' ELSE s END AS start_date,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN DATE '2001-09-12' ELSE s + n END AS end_date
  FROM asked
),
labelled AS (
  SELECT w.*, last_week,
         greatest(start_date + CAST((7 - isodow(start_date)) AS INTEGER), last_week + 7) AS first_label,
         end_date - CAST(isodow(end_date) % 7 AS INTEGER) AS last_label,
         end_date + CAST((7 - isodow(end_date)) AS INTEGER) AS end_week
  FROM windows w LEFT JOIN spans USING (hotspot_id_x, hotspot_id_y)
),
resolved AS (
  SELECT *, CASE WHEN last_week IS NULL THEN 'not_found'
                 WHEN start_date > end_date THEN 'start_after_end'
                 WHEN end_week <= last_week THEN 'end_before_training'
                 WHEN first_label > last_label THEN 'empty_slice'
                 ELSE 'ok' END AS status
  FROM labelled
)"""

ORACLES = {
    "clean_incidents": f"""WITH {RAW}
        SELECT ts AS "Timestamp", latitude AS "Latitude", longitude AS "Longitude",
               primary_type, CAST(year(ts) AS INTEGER) AS "Year", CAST(week(ts) AS INTEGER) AS "Week"
        FROM parsed WHERE ts IS NOT NULL AND NOT isnan(latitude) AND latitude <> 0 AND longitude <> 0""",
    "clean_projected": f"""WITH {RAW},{_holidays(WIDE_YEARS)}
        SELECT id, ts, x, y, CAST(ts AS DATE) IN (SELECT holiday_date FROM holidays) AS is_holiday
        FROM parsed WHERE ts IS NOT NULL AND x IS NOT NULL AND NOT isnan(latitude)""",
    "clean_row_counts": f"""WITH {RAW}
        SELECT count(*) AS raw_rows,
               count(*) FILTER (WHERE ts IS NOT NULL AND NOT isnan(latitude) AND latitude <> 0 AND longitude <> 0) AS clean_rows
        FROM parsed""",
    "first_rows": f"WITH {INCIDENTS} SELECT id, ts AS Timestamp FROM incidents ORDER BY id LIMIT 5",
    "parse_timestamp": f"""WITH {RAW}
        SELECT id, ts, try_cast(coalesce(date_text, block) AS DOUBLE) AS as_number,
               try_cast(substr(case_number, 2) AS DOUBLE) AS case_number,
               CASE WHEN id % 3 = 0 THEN CAST(id AS DOUBLE) END AS suffixed
        FROM parsed""",
    "date_features": f"""WITH {INCIDENTS}
        SELECT id, year(ts) AS year, month(ts) AS month, week(ts) AS week, dayofweek(ts) + 1 AS dayofweek,
               CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, strftime(ts, '%Y-%m-%d') AS iso_day,
               date_diff('day', date_trunc('week', ts), DATE '2001-12-31') // 7 AS weeks_to_2002
        FROM incidents""",
    "holiday_calendar": f"""WITH {INCIDENTS},{_holidays(DATA_YEARS)} SELECT holiday_date FROM holidays""",
    "year_range": f"WITH {INCIDENTS} {DATA_YEARS}",
    "holiday_flag": f"""WITH {INCIDENTS},{_holidays(DATA_YEARS)}
        SELECT id, day AS date_only, holiday_date, holiday_date IS NOT NULL AS is_holiday
        FROM incidents LEFT JOIN holidays ON day = holiday_date""",
    "grid_cell_counts": f"""WITH {INCIDENTS}
        SELECT grid_x, grid_y, count(*) AS crime_count FROM incidents GROUP BY ALL""",
    "grid_hotspots": f"WITH {HOTSPOTS} SELECT * FROM hotspots",
    "grid_hotspot_summary": f"""WITH {HOTSPOTS}
        SELECT hotspot_id_x, hotspot_id_y,
               (hotspot_id_y + CAST(0.5 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS lat,
               (hotspot_id_x + CAST(0.5 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS lon,
               crime_count, sqrt(crime_count) / 2 AS marker_radius
        FROM hotspots""",
    "top_hotspots": f"""WITH {HOTSPOTS}
        SELECT * FROM hotspots ORDER BY crime_count DESC, hotspot_id_x, hotspot_id_y LIMIT 10""",
    "hotspot_incidents": f"""WITH {HOTSPOTS}
        SELECT id, hotspot_id_x, hotspot_id_y, crime_count
        FROM incidents JOIN hotspots ON grid_x = hotspot_id_x AND grid_y = hotspot_id_y""",
    "weekly_series": f"""WITH {SERIES}
        SELECT hotspot_id_x, hotspot_id_y, week_end, y, holiday_incidents, holiday_days FROM series""",
    "weekly_holiday_incidents": f"""WITH {ALL_CELLS}
        SELECT hotspot_id_x AS grid_x, hotspot_id_y AS grid_y, week_end, y, holiday_incidents FROM weekly""",
    "series_span": f"WITH {SPANS} SELECT * FROM spans",
    "series_with_history": f"""WITH {ALL_CELLS}
        SELECT hotspot_id_x AS grid_x, hotspot_id_y AS grid_y, week_end, y, holiday_incidents, holiday_days
        FROM series QUALIFY count(*) OVER (PARTITION BY hotspot_id_x, hotspot_id_y) >= 330""",
    "future_weeks_exog": f"""WITH {SPANS},{AHEAD},
        ahead AS (
          SELECT hotspot_id_x, hotspot_id_y,
                 CAST(unnest(generate_series(last_week + 7, DATE '2003-01-05', INTERVAL 7 DAY)) AS DATE) AS week_end
          FROM spans)
        SELECT hotspot_id_x, hotspot_id_y, week_end, coalesce(n, 0) AS holiday_count,
               coalesce(n, 0) > 0 AS is_holiday_week
        FROM ahead LEFT JOIN ahead_weeks USING (week_end)""",
    "seasonal_features": f"WITH {DIFFERENCED} SELECT * FROM differenced",
    "training_outcomes": f"""WITH {ALL_CELLS},
        sizes AS (SELECT hotspot_id_x, hotspot_id_y, count(*) AS n FROM series GROUP BY ALL)
        SELECT hotspot_id_x AS grid_x, hotspot_id_y AS grid_y, n >= 330 AS training_successful,
               CASE WHEN n < 330 THEN n || ' weeks of data, 330 needed' END AS error_message
        FROM sizes""",
    "train_each": f"""WITH {ALL_CELLS},
        sizes AS (SELECT hotspot_id_x, hotspot_id_y, count(*) AS n FROM series GROUP BY ALL)
        SELECT hotspot_id_x AS grid_x, hotspot_id_y AS grid_y, n >= 335 AS training_successful,
               CASE WHEN n < 335 THEN 'short series' END AS error_message
        FROM sizes""",
    "trend_forecast": f"""WITH {SERIES},
        short AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY hotspot_id_x, hotspot_id_y ORDER BY week_end) <= 60),
        lines AS (
          SELECT hotspot_id_x, hotspot_id_y, max(week_end) AS last_week,
                 regr_slope(y, date_diff('day', DATE '1970-01-04', week_end) / 7) AS b,
                 regr_intercept(y, date_diff('day', DATE '1970-01-04', week_end) / 7) AS a
          FROM short GROUP BY ALL),
        ahead AS (SELECT *, unnest(range(1, 11)) AS step FROM lines)
        SELECT hotspot_id_x, hotspot_id_y, CAST(last_week + CAST(7 * step AS INTEGER) AS DATE) AS week_end,
               round(a + b * (date_diff('day', DATE '1970-01-04', last_week) / 7 + step), 6) AS predicted
        FROM ahead""",
    "forecast_requests": f"""WITH {REQUESTS}
        SELECT request_id, hotspot_id_x, hotspot_id_y, start_date, end_date, status,
               CASE status WHEN 'ok' THEN 200 WHEN 'not_found' THEN 404 ELSE 400 END AS code,
               CASE WHEN status = 'ok' THEN first_label END AS first_label,
               CASE WHEN status = 'ok' THEN last_label END AS last_label
        FROM resolved""",
    "csv_parquet_roundtrip": f"""WITH {RAW}
        SELECT id, case_number, date_text, primary_type, x, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude,
               isnan(latitude) AS not_a_number, longitude, location FROM raw""",
}
ORACLES["holiday_join_calendar"] = ORACLES["holiday_flag"]
ORACLES["csv_lenient"] = ORACLES["clean_projected"]
ORACLES["approximate_threshold"] = f"""WITH {HOTSPOTS},
    bounds AS (SELECT count(*) AS n_cells, quantile_disc(crime_count, 0.94) AS low, quantile_disc(crime_count, 0.96) AS high,
                      quantile_disc(crime_count, 0.95) AS exact FROM cells)
    SELECT n_cells, low, high, exact BETWEEN low AND high AS within FROM bounds"""
ORACLES["grid_hotspots_approximate"] = f"""WITH {HOTSPOTS}
    SELECT grid_x AS hotspot_id_x, grid_y AS hotspot_id_y, crime_count, true AS found FROM cells
    WHERE crime_count > (SELECT quantile_disc(crime_count, 0.96) FROM cells)"""

# Murmur3 (32 bits, seed 42) of an ASCII text: words of four bytes, then single bytes.
_MASK = 4294967295


def _times(a: str, b: int) -> str:
    return f"CAST(CAST({a} AS HUGEINT) * {b} % 4294967296 AS BIGINT)"


def _turn(a: str, n: int) -> str:
    return f"((({a}) << {n}) & {_MASK} | (({a}) >> {32 - n}))"


def _murmur3(text: str) -> str:
    """Signed hash of a text column."""
    mixed = _times(_turn(_times("k", 0xCC9E2D51), 15), 0x1B873593)
    step = f"({_times(_turn(f'xor(h, {mixed})', 13), 5)} + {0xE6546B64}) & {_MASK}"
    words = (
        f"list_concat([CAST(42 AS BIGINT)], list_transform(range(0, length({text}) // 4), lambda i: "
        f"CAST(ascii({text}[4*i+1]) + ascii({text}[4*i+2]) * 256 + ascii({text}[4*i+3]) * 65536 "
        f"+ ascii({text}[4*i+4]) * 16777216 AS BIGINT)), "
        f"list_transform(range(length({text}) // 4 * 4, length({text})), lambda i: CAST(ascii({text}[i+1]) AS BIGINT)))"
    )
    body = f"xor(list_reduce({words}, lambda h, k: CAST({step} AS BIGINT)), length({text}))"
    last = lambda h, n: f"xor({h}, ({h}) >> {n})"
    return f"(SELECT CASE WHEN f > 2147483647 THEN f - 4294967296 ELSE f END FROM (SELECT {last('e', 16)} AS f FROM (SELECT {_times(last('d', 13), 0xC2B2AE35)} AS e FROM (SELECT {_times(last('c', 16), 0x85EBCA6B)} AS d FROM (SELECT {body} AS c)))))"


NAMED = HOTSPOTS + f""",
texts AS (SELECT *, hotspot_id_x || '_' || hotspot_id_y AS t FROM hotspots),
named AS (SELECT *, abs(CAST({_murmur3("t")} AS BIGINT)) % 100000 AS id FROM texts)"""
ORACLES["hotspot_combined_id"] = f"""WITH {NAMED}
    SELECT hotspot_id_x, hotspot_id_y, crime_count, id AS hotspot_id_combined FROM named"""
ORACLES["grid_hotspot_json"] = f"""WITH {NAMED}
    SELECT id, (hotspot_id_y + CAST(0.5 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS lat,
           (hotspot_id_x + CAST(0.5 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS lon, crime_count FROM named"""
ORACLES["hotspot_definitions"] = ORACLES["grid_hotspot_json"]

TERMS = ["lag(w, 1) OVER s", "lag(w, 2) OVER s", "lag(w, 3) OVER s", "lag(w, 52) OVER s", "lag(w, 53) OVER s", "dx"]
ORACLES["seasonal_cross_products"] = f"""WITH {DIFFERENCED},
    lags AS (
      SELECT hotspot_id_x, hotspot_id_y, w, lag(w, 53) OVER s AS deepest,
             {", ".join(f"{t} AS t{k}" for k, t in enumerate(TERMS))}
      FROM differenced WINDOW s AS (PARTITION BY hotspot_id_x, hotspot_id_y ORDER BY week_end)
    ),
    totals AS (
      SELECT hotspot_id_x, hotspot_id_y, count(deepest) AS n_obs,
             {", ".join(f"CAST(sum(t{k} * w) FILTER (WHERE deepest IS NOT NULL) AS DOUBLE) AS s{k}" for k in range(6))}
      FROM lags GROUP BY ALL
    )
    {" UNION ALL ".join(f"SELECT hotspot_id_x, hotspot_id_y, n_obs, {k} AS term, coalesce(s{k}, 0) AS total FROM totals" for k in range(6))}"""

POINTS = """
points AS (
  SELECT event_id AS id, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events
)"""


def _kdist(k: int) -> str:
    """CTE kdist(id, k_dist) by brute force over all pairs."""
    return POINTS + f""",
kdist AS (
  SELECT a.id, sqrt(list_last(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), {k}))) AS k_dist
  FROM points a, points b GROUP BY a.id
)"""


ORACLES["knn_kdist"] = f"WITH {_kdist(64)} SELECT * FROM kdist"
ORACLES["nearest_other"] = f"WITH {_kdist(2)} SELECT * FROM kdist"
ORACLES["density_levels"] = f"""WITH {_kdist(64)},
    ordered AS (
      SELECT id, k_dist, row_number() OVER s - 1 AS rank, lead(k_dist) OVER s - k_dist AS variation,
             (lead(k_dist) OVER s - lag(k_dist, 499) OVER s) / 500 AS mean
      FROM kdist WINDOW s AS (ORDER BY k_dist, id)
    ),
    smooth AS (
      SELECT rank, id, variation, CASE WHEN rank < 499 THEN variation ELSE mean END AS smoothed
      FROM ordered WHERE variation IS NOT NULL
    )
    SELECT *, smoothed <= (SELECT quantile_cont(smoothed, 0.73) FROM smooth) AS in_level FROM smooth"""

# eps 1.25 and min_pts 10, as in the queries. The recursion keeps one row per core point and
# lowers its component until nothing changes.
LABELS = POINTS + """,
near AS MATERIALIZED (
  SELECT a.id, b.id AS other FROM points a, points b
  WHERE abs(a.y - b.y) <= 1.25
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST(1.25 AS DOUBLE) * CAST(1.25 AS DOUBLE)
),
core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING count(*) >= 10),
links AS MATERIALIZED (SELECT id, other FROM near SEMI JOIN core USING (id) WHERE other IN (SELECT id FROM core)),
comp(id, root) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT l.other, min(c.root) FROM comp c JOIN links l ON l.id = c.id
       JOIN recurring.comp o ON o.id = l.other
  WHERE c.root < o.root GROUP BY l.other
),
numbered AS (
  SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM comp
),
labels AS (
  SELECT p.id, CAST(coalesce(min(own.cluster), min(c.cluster), -1) AS INTEGER) AS cluster
  FROM points p LEFT JOIN numbered own ON own.id = p.id
       LEFT JOIN near n ON n.id = p.id LEFT JOIN numbered c ON c.id = n.other
  GROUP BY p.id
),
labelled AS (SELECT * FROM points JOIN labels USING (id))"""

ORACLES["dbscan_labels"] = f"WITH RECURSIVE {LABELS} SELECT id, cluster FROM labels"
ORACLES["cluster_summary"] = f"""WITH RECURSIVE {LABELS}
    SELECT CAST(cluster AS BIGINT) AS id, round(avg(y), 6) AS lat, round(avg(x), 6) AS lon, count(*) AS crime_count
    FROM labelled WHERE cluster <> -1 GROUP BY cluster"""
ORACLES["cluster_pages"] = f"""WITH RECURSIVE {LABELS},
    placed AS (
      SELECT cluster, y, x, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS rank,
             count(*) OVER (PARTITION BY cluster) AS crime_count
      FROM labelled WHERE cluster <> -1)
    SELECT CAST(cluster AS BIGINT) AS id, rank // 100 AS page, crime_count, rank % 100 AS place, y AS lat, x AS lon
    FROM placed"""
ORACLES["cluster_counts"] = f"WITH RECURSIVE {LABELS} SELECT cluster, count(*) AS n FROM labels GROUP BY cluster"
ORACLES["cluster_totals"] = f"""WITH RECURSIVE {LABELS}
    SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters,
           count(*) FILTER (WHERE cluster = -1) AS n_noise FROM labels"""
ORACLES["cluster_ids"] = f"WITH RECURSIVE {LABELS} SELECT DISTINCT cluster FROM labels WHERE cluster <> -1"
ORACLES["cluster_report_json"] = f"""WITH RECURSIVE {LABELS},
    placed AS (
      SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS rank,
             count(*) OVER (PARTITION BY cluster) AS crime_count
      FROM labels WHERE cluster <> -1)
    SELECT CAST(cluster AS BIGINT) AS id, rank // 100 AS page, crime_count, count(*) AS n_points
    FROM placed GROUP BY ALL"""
ORACLES["cluster_job_rows"] = f"""WITH RECURSIVE {LABELS}
    SELECT CASE WHEN id % 7 <> 0 THEN id % 500 + 5000000000 END AS incident_id, x, y, cluster = -1 AS is_noise FROM labelled"""
_PLACED_LABELS = LABELS.replace("FROM events\n", "FROM events WHERE event_id % 10 <> 0\n")
ORACLES["dbscan_unplaced"] = f"""WITH RECURSIVE {_PLACED_LABELS}
    SELECT id, cluster FROM labels UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 10 = 0"""
