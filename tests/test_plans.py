"""The submit-ready jobs, end to end on small files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweek.plans import cluster_forecast, convert, grid_forecast, serve
from cellweek.schema import INCIDENT_SCHEMA
from cellweek.sources import incidents as io
from cellweek.sources.publish import current_path, publish

HEADER = ",".join(f.name for f in INCIDENT_SCHEMA)


def incident_file(tmp_path):
    """Two busy places and scattered incidents over about a year and a half."""
    rng = np.random.default_rng(11)
    places = [(41.8805, -87.6305, 1000.0, 2000.0)] * 500 + [(41.9005, -87.6505, 9000.0, 8000.0)] * 450
    places += [(41.5 + i * 0.002 + 0.0005, -87.5005, 20000.0 + 700 * i, 0.0) for i in range(60)]
    lines = []
    for i, (lat, lon, x, y) in enumerate(places):
        when = dt.datetime(2023, 1, 2) + dt.timedelta(minutes=int(rng.integers(0, 540 * 1440)))
        text = when.strftime("%m/%d/%Y %I:%M:%S %p")
        jitter = rng.normal(0, 20, 2)
        lines.append(
            f'{i},C{i},{text},B,I,THEFT,D,L,true,false,1,2,3,4,5,{x + jitter[0]},{y + jitter[1]},2023,u,{lat},{lon},"({lat}, {lon})"'
        )
    path = tmp_path / "in.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_grid_job_and_answers(spark, tmp_path):
    parquet, out = str(tmp_path / "incidents"), str(tmp_path / "out")
    convert.convert(spark, incident_file(tmp_path), parquet)
    grid_forecast.run(spark, parquet, out, q=0.95, season=4)
    hot = serve.hotspot_list(spark, out).orderBy("crime_count").collect()
    assert [r.crime_count for r in hot] == [450, 500]
    assert abs(hot[1].centroid.lat - 41.8805) < 1e-9 and abs(hot[1].centroid.lon + 87.6305) < 1e-9
    trained = spark.read.csv(current_path(spark, f"{out}/training_results"), header=True, inferSchema=True).collect()
    assert len(trained) == 2 and all(r.training_successful for r in trained)
    report, status = serve.forecast(spark, out, hot[1].id, "2024-07-01", "2024-07-31", season=4)
    assert [tuple(r)[1:] for r in status.select("request_id", "status", "code").collect()] == [("ok", 200)]
    got = report.first()
    assert got.hotspot_id == hot[1].id
    assert [b.date for b in got.forecast_breakdown] == ["2024-07-07", "2024-07-14", "2024-07-21", "2024-07-28"]
    assert [b.is_holiday_week for b in got.forecast_breakdown] == [False] * 4
    _, missing = serve.forecast(spark, out, 123456, "2024-07-01", "2024-07-31", season=4)
    assert missing.first()["code"] == 404
    asked = io.read_table(spark, f"{out}/models").select(
        F.col("hotspot_id_y").alias("request_id"),
        *grid_forecast.KEYS,
        F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
    )
    reports, statuses = serve.answer(
        spark, out, asked, grid_forecast.KEYS, "hotspot_id_combined", 4, F.lit("2024-08-01").cast("date")
    )
    assert reports.count() == 2 and statuses.where("code = 200").count() == 2


def test_short_ids_that_collide_stay_apart(spark, tmp_path):
    parquet, out = str(tmp_path / "incidents"), str(tmp_path / "out")
    convert.convert(spark, incident_file(tmp_path), parquet, ["Year"])
    assert (tmp_path / "incidents" / "Year=2023").is_dir()
    grid_forecast.run(spark, parquet, out, q=0.95, season=4)
    models = io.read_table(spark, f"{out}/models").withColumn("hotspot_id_combined", F.lit(7).cast("bigint"))
    both = str(tmp_path / "both")
    models.write.parquet(f"{both}/models")
    reports, status = serve.forecast(spark, both, 7, "2024-07-01", "2024-07-31", season=4)
    cells = {(r.hotspot_id_x, r.hotspot_id_y) for r in status.collect()}
    assert cells == {(r.hotspot_id_x, r.hotspot_id_y) for r in models.collect()} and status.count() == 2
    assert [r.hotspot_id for r in reports.collect()] == [7, 7]


def test_cluster_job_keeps_every_row(spark, tmp_path):
    lines = open(incident_file(tmp_path)).read().splitlines()
    for i in range(1, 31):
        first, rest = lines[i].split(",", 1)
        lines[i] = ",".join([["", "5077", str(2**31 + i)][i % 3], rest])
    path = tmp_path / "ids.csv"
    path.write_text("\n".join(lines) + "\n")
    cluster_forecast.run(spark, str(path), str(tmp_path / "out"))
    labels = io.read_table(spark, str(tmp_path / "out" / "labels"))
    assert labels.count() == len(lines) - 1 == labels.select("id").distinct().count()
    assert labels.where("incident_id IS NULL").count() == 10 and labels.where("incident_id = 5077").count() == 10
    assert labels.where(f"incident_id > {2**31}").count() == 10
    asked = str(tmp_path / "asked")
    models = io.read_table(spark, str(tmp_path / "out" / "models"))
    models.selectExpr("hotspot_id AS request_id", "hotspot_id", "date '2024-09-01' AS start_date", "date '2024-09-30' AS end_date").write.parquet(asked)
    serve.run(spark, str(tmp_path / "out"), asked, str(tmp_path / "answers"), "cluster")
    assert io.read_table(spark, str(tmp_path / "answers" / "statuses")).where("code = 200").count() == models.count() > 0
    assert io.read_table(spark, str(tmp_path / "answers" / "hotspots")).count() > 0


def test_cluster_job(spark, tmp_path):
    out = str(tmp_path / "out")
    cluster_forecast.run(spark, incident_file(tmp_path), out)
    hotspots = {r.id: r for r in serve.cluster_list(spark, out).collect()}
    assert {i: r.crime_count for i, r in hotspots.items()} == {0: 500, 1: 450}
    assert len(hotspots[0].points) == 500 and abs(hotspots[1].centroid.lat - 41.9005) < 1e-9
    models = io.read_table(spark, f"{out}/models")
    assert models.where("status = 'ok'").count() == 2
    until = models.withColumn("until", F.lit("2024-09-01").cast("date"))
    from cellweek.operators.rollout import forecast_rows

    assert forecast_rows(until, ["hotspot_id"], 4, "until").where("predicted IS NULL").isEmpty()


def scanned_rows(df):
    """Rows that the Parquet scans of an executed query put out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    plans, total = [node], 0
    while plans:
        p = plans.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(p.executedPlan())
            continue
        if name.startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


def test_a_model_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "models")
    n = 40_000
    models = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("hotspot_id_x"),
        (F.col("id") % 5).alias("hotspot_id_y"),
        (F.xxhash64("id") % 1_000_000_007).alias("hotspot_id_combined"),
        F.rand(1).alias("coef"),
    )
    io.publish_models(models, path, grid_forecast.KEYS, rows=1000)
    stored = io.read_table(spark, path)
    wanted = stored.where("hotspot_id_x = 12345").first()
    found = io.model_for(stored, wanted.hotspot_id_x, wanted.hotspot_id_y)
    assert "EqualTo(hotspot_id_x,12345)" in found._jdf.queryExecution().executedPlan().toString()
    assert 1 <= scanned_rows(found) <= 1000 and found.first() == wanted
    by_id = io.models_with_id(stored, wanted.hotspot_id_combined)
    assert "EqualTo(hotspot_id_combined" in by_id._jdf.queryExecution().executedPlan().toString()
    # The ids are spread over all groups, so only the Bloom filters can tell; some are wrong.
    assert 1 <= scanned_rows(by_id) <= 5000 and by_id.first() == wanted
    assert scanned_rows(io.models_with_id(stored, -5)) <= 5000


def test_an_interrupted_write_leaves_the_old_result(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "result")
    for n in (3, 5):
        io.publish_table(spark.range(n), path)
        assert io.read_table(spark, path).count() == n
    old = io.read_table(spark, path)

    @F.udf("long")
    def breaks(i):
        if i == 900:
            raise RuntimeError("stopped in the middle")
        return i

    with pytest.raises(Exception, match="stopped in the middle"):
        io.publish_table(spark.range(0, 1000, 1, 4).select(breaks("id").alias("id")), path)
    assert io.read_table(spark, path).count() == 5 == old.count()

    def complete_but_not_named(folder):
        io.write_table(spark.range(9), folder)
        raise RuntimeError("lost the driver")

    with pytest.raises(RuntimeError):
        publish(spark, path, complete_but_not_named)
    assert io.read_table(spark, path).count() == 5
    io.publish_table(old.union(spark.range(1)), path)
    assert io.read_table(spark, path).count() == 6 and old.count() == 5
    io.publish_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.csv(current_path(spark, str(tmp_path / "csv")), header=True).count() == 2


def test_jobs_read_and_replace_single_years(spark, tmp_path):
    target = str(tmp_path / "incidents")
    lines = open(incident_file(tmp_path)).read().splitlines()
    by_year = {y: [",".join([*line.split(",")[:17], str(y), *line.split(",")[18:]]) for line in lines[1:]] for y in (2021, 2022, 2023)}

    def store(name, rows):
        (tmp_path / name).write_text("\n".join([HEADER, *rows]) + "\n")
        convert.convert(spark, str(tmp_path / name), target, ["Year"])

    store("all.csv", [r for y in by_year for r in by_year[y]])
    store("one.csv", by_year[2022][:40])
    counts = {r.Year: r["count"] for r in io.read_table(spark, target, INCIDENT_SCHEMA).groupBy("Year").count().collect()}
    assert counts == {2021: len(lines) - 1, 2022: 40, 2023: len(lines) - 1}
    some = io.of_years(io.read_table(spark, target, INCIDENT_SCHEMA), 2022, 2022)
    plan = grid_forecast.cell_weeks(grid_forecast.clean_incidents(some))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan.replace("IsNotNull", "isnotnull") and "(Year" in plan
    assert scanned_rows(some) == 40
    out = str(tmp_path / "out")
    grid_forecast.run(spark, target, out, q=0.5, season=4, first_year=2021, last_year=2022)
    total = io.read_table(spark, f"{out}/weekly_series").agg(F.sum("y")).first()[0]
    assert 0 < total < len(lines) - 1 + 40
