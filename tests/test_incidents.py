import datetime as dt

from pyspark.sql import functions as F

from cellweek.functions.holidays import holiday_calendar
from cellweek.operators import clean, grid, holiday_join, skew, weekly
from cellweek.schema import INCIDENT_SCHEMA
from cellweek.sources import incidents as io

HEADER = ",".join(f.name for f in INCIDENT_SCHEMA)


def line(number, date, x, y, lat, lon):
    return f'{number},C{number},{date},B,I,THEFT,D,L,true,false,1,2,3,4,5,{x},{y},1999,u,{lat},{lon},"({lat}, {lon})"'


def write_csv(tmp_path, lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


LINES = [
    line(1, "01/01/2024 12:00:00 AM", 10, 20, 41.8, -87.6),
    line(2, "1/2/2024 3:00:00 PM", 11, 21, 41.8, -87.6),
    line(3, "", 11, 21, 41.8, -87.6),
    line(4, "bad", 11, 21, 41.8, -87.6),
    line(5, "01/03/2024 01:00:00 PM", 11, 21, 0, -87.6),
    line(6, "01/03/2024 01:00:00 PM", 11, 21, 41.8, 0),
    line(7, "01/03/2024 01:00:00 PM", 11, 21, "", -87.6),
    line(8, "01/03/2024 01:00:00 PM", "n/a", 21, 41.8, -87.6),
    "9,C9",
]


def test_csv_keeps_the_schema_and_finds_bad_rows(spark, tmp_path):
    path = write_csv(tmp_path, LINES)
    df = io.read_incident_csv(spark, path)
    assert df.schema == INCIDENT_SCHEMA
    assert df.where("ID = 1").first()["Location"] == "(41.8, -87.6)"
    marked = io.read_incident_csv(spark, path, keep_corrupt=True)
    assert {r.ID for r in marked.collect() if r._corrupt_record is not None} == {8, 9}
    lengths = marked.select("ID", "_corrupt_record").collect()
    assert {r.ID for r in lengths if r._corrupt_record is not None} == {9}


def test_clean_incidents(spark, tmp_path):
    got = clean.clean_incidents(io.read_incident_csv(spark, write_csv(tmp_path, LINES)))
    assert got.columns == ["Timestamp", "Latitude", "Longitude", "Primary Type", "Year", "Week"]
    rows = got.orderBy("Timestamp").collect()
    assert [r.Timestamp.day for r in rows] == [1, 2, 3]
    assert {r.Year for r in rows} == {2024} and {r.Week for r in rows} == {1}


def test_clean_projected(spark, tmp_path):
    got = clean.clean_projected(io.read_incident_csv(spark, write_csv(tmp_path, LINES), lenient=True))
    rows = {r.ID: r.is_holiday for r in got.collect()}
    assert rows == {1: True, 2: False, 5: False, 6: False}


def test_parquet_filters_reach_the_scan(spark, tmp_path):
    target = str(tmp_path / "p")
    io.write_table(io.read_incident_csv(spark, write_csv(tmp_path, LINES)), target)
    df = clean.clean_incidents(io.read_table(spark, target, INCIDENT_SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(Latitude)" in plan and "Not(EqualTo(Longitude,0.0))" in plan
    assert "Location Description" not in plan


def test_partitioned_write(spark, tmp_path):
    target = str(tmp_path / "p")
    io.write_table(io.read_incident_csv(spark, write_csv(tmp_path, LINES[:4])), target, ["Year"])
    assert io.read_table(spark, target).where("Year = 1999").count() == 4


def incidents(spark, cells):
    """cells: {(i, j): count}; points at cell centres."""
    rows = [(i * 0.001 + 0.0005, j * 0.001 + 0.0005) for (i, j), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "Longitude double, Latitude double")


def test_threshold_is_strict_and_ties_give_no_hotspot(spark):
    same = incidents(spark, {(i, 1): 3 for i in range(20)})
    assert grid.grid_hotspots(same).count() == 0
    mixed = incidents(spark, {(i, 1): 1 for i in range(39)} | {(-50, 2): 9})
    got = grid.grid_hotspots(mixed).collect()
    assert [(r.hotspot_id_x, r.hotspot_id_y, r.crime_count) for r in got] == [(-50, 2, 9)]
    assert grid.grid_hotspots(mixed, relative_error=0.01).count() == 1


def test_no_incidents_give_no_hotspots(spark):
    empty = spark.createDataFrame([], "Longitude double, Latitude double")
    assert grid.grid_hotspots(empty).count() == 0
    assert grid.grid_hotspots(empty, relative_error=0.01).count() == 0


def test_top_hotspots_breaks_ties_by_cell(spark):
    hot = spark.createDataFrame([(2, 1, 5), (1, 1, 5), (3, 3, 9)], "hotspot_id_x long, hotspot_id_y long, crime_count long")
    assert [r.hotspot_id_x for r in grid.top_hotspots(hot, 2).collect()] == [3, 1]


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(30_000).select(
        "id", F.when(F.col("id") < 10_000, 7).when(F.col("id") < 10_050, None).otherwise(F.col("id") % 500).alias("k")
    )
    lookup = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    for how in ("inner", "left"):
        plain = facts.join(lookup, ["k"], how)
        salted = skew.lookup_join(facts, lookup, ["k"], how, limit=10)
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    names = {r.h: r.k for r in facts.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    hot = skew.hot_keys(facts, ["k"])
    slices = {names[r._key]: r._slices for r in hot.collect()}
    assert slices[7] == 335 and None not in slices and max(v for k, v in slices.items() if k != 7) <= 2
    # One sketch per task crosses the network, and no key does.
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "partial_approx_top_k" in plan and "hashpartitioning" not in plan


def test_salted_join_of_keys_in_different_types(spark):
    facts = spark.range(9_000).select("id", F.when(F.col("id") < 8_000, 7).otherwise(F.col("id") % 90).cast("int").alias("k"))
    facts = facts.withColumn("d", F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)))
    lookup = spark.createDataFrame([(7, 0.0, "a"), (8, 0.0, "b"), (2**40, 0.0, "c")], "k long, d double, v string")
    salted = skew.salted_join(facts, lookup, ["k", "d"])
    assert salted.count() == facts.join(lookup, ["k", "d"]).count() > 8_000


def test_hot_keys_are_found_among_very_many_keys(spark):
    n = 400_000
    facts = spark.range(n).select(F.when(F.col("id") % 400 == 0, F.lit(-1)).when(F.col("id") % 3 == 0, F.lit(-2)).otherwise(F.col("id")).alias("k"))
    counts = {r.k: r.n for r in facts.where("k < 0").groupBy("k").agg(F.count("*").alias("n")).collect()}
    names = {r.h: r.k for r in spark.createDataFrame([(-1,), (-2,)], "k long").select("k", F.xxhash64("k").alias("h")).collect()}
    slices = {names.get(r._key): r._slices for r in skew.hot_keys(facts, ["k"]).collect()}
    assert set(slices) >= {-1, -2} and len(slices) <= 2 * skew.SLICES
    assert all(abs(slices[k] - counts[k] * skew.SLICES / n) <= 2 for k in (-1, -2))


def test_counts_of_the_cleaning_write(spark, tmp_path):
    raw = io.read_incident_csv(spark, write_csv(tmp_path, LINES))
    odd = raw.limit(1).withColumns({"Latitude": F.lit(float("nan")), "Date": F.lit("01/02/2003 01:00:00 AM"), "Longitude": F.lit(1.0)})
    missing = odd.withColumn("Latitude", F.lit(None).cast("double"))
    usable = odd.withColumn("Latitude", F.lit(2.0))
    table = raw.union(odd).union(missing).union(usable)
    want = clean.clean_incidents(table).count()
    counted = clean.write_counted(table, clean.clean_incidents, str(tmp_path / "clean")).first()
    assert tuple(counted) == (raw.count() + 3, want) and io.read_table(spark, str(tmp_path / "clean")).count() == want
    assert tuple(clean.write_counted(usable.union(odd), clean.clean_incidents, str(tmp_path / "two")).first()) == (2, 1)
    assert tuple(clean.write_counted(raw.where("ID = -5"), clean.clean_incidents, str(tmp_path / "none")).first()) == (0, 0)


def test_small_lookups_are_broadcast_and_large_ones_are_not(spark):
    facts = spark.range(1000).select(F.col("id").alias("k"))
    lookup = spark.range(100).select(F.col("id").alias("k"))
    small = skew.lookup_join(facts, lookup, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    large = skew.lookup_join(facts, lookup, ["k"], limit=10)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()


def test_holiday_expression_equals_calendar_join(spark):
    days = spark.range(3000).select(
        F.date_add(F.lit("2018-01-01"), F.col("id").cast("int")).cast("timestamp").alias("Timestamp")
    )
    direct = holiday_join.flag_holidays(days)
    joined = holiday_join.join_calendar(days, holiday_calendar(spark, 2018, 2027)).select(direct.columns)
    assert direct.exceptAll(joined).isEmpty() and joined.exceptAll(direct).isEmpty()


def test_weekly_series_equals_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    stamps = pd.Timestamp("2021-01-01") + pd.to_timedelta(rng.integers(0, 300 * 86400, 400) ** 1.0, unit="s")
    pdf = pd.DataFrame({"key": rng.integers(0, 12, 400), "Timestamp": stamps.floor("s")})
    got = weekly.weekly_series(spark.createDataFrame(pdf), ["key"]).toPandas()
    assert got.y.sum() == 400
    for key, part in pdf.groupby("key"):
        want = part.set_index("Timestamp").resample("W").size()
        mine = got[got.key == key].sort_values("week_end")
        assert list(mine.y) == list(want)
        assert list(mine.week_end) == [d.date() for d in want.index]


def test_cell_weeks_hold_everything_the_grid_needs(spark):
    rows = [(0.0005, 0.0005, dt.datetime(2024, 1, d)) for d in (1, 1, 9, 30)] + [(0.5005, 0.5005, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "Longitude double, Latitude double, Timestamp timestamp")
    weeks = weekly.cell_weeks(df)
    hot = weekly.hotspots_from_weeks(weeks, q=0.5)
    assert [(r.hotspot_id_x, r.crime_count) for r in hot.collect()] == [(0, 4)]
    series = weekly.hotspot_series_from_weeks(weeks, hot).orderBy("week_end").collect()
    assert [r.y for r in series] == [2, 1, 0, 0, 1]
    assert [r.holiday_incidents for r in series] == [2, 0, 0, 0, 0]
    assert [r.holiday_days for r in series] == [1, 0, 1, 0, 0]


def test_a_hotspot_join_keeps_every_incident(spark):
    df = incidents(spark, {(i, 1): 1 for i in range(39)} | {(50, 2): 400})
    hot = grid.grid_hotspots(df)
    assert grid.hotspot_incidents(df, hot).count() == 400
