import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweek.operators import clusters, components, dbscan, density, nearest, ranking, skew


def frame(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


def brute_k_distance(xy, k):
    xy = np.asarray(xy, float)
    dx, dy = xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]
    return np.sqrt(np.sort(dx * dx + dy * dy, axis=1)[:, k - 1])


def skewed_points(n, seed=0):
    """A third of the points at one place, a third in a tiny city, the rest spread widely."""
    rng = np.random.default_rng(seed)
    third = n // 3
    return np.vstack(
        [np.full((third, 2), 3.25), rng.normal(0, 0.01, (third, 2)), rng.normal(0, 50, (n - 2 * third, 2))]
    )


@pytest.mark.parametrize("split", [256, 3])
def test_k_distance_equals_brute_force_on_skewed_points(spark, monkeypatch, split):
    monkeypatch.setattr(nearest, "SPLIT_ABOVE", split)
    xy = skewed_points(1500)
    got = {r.id: r.k_dist for r in nearest.k_distance(frame(spark, xy), 8, tile=16).collect()}
    want = brute_k_distance(xy, 8)
    assert len(got) == len(xy)
    assert all(got[i] == want[i] for i in range(len(xy)))


def test_tasks_of_the_search_hold_few_rows(spark, monkeypatch):
    seen = []

    def watched(frontier, k, prune=nearest._prune):
        seen.append([r["count"] for r in frontier.groupBy(F.spark_partition_id()).count().collect()])
        return prune(frontier, k)

    monkeypatch.setattr(nearest, "_prune", watched)
    monkeypatch.setattr(nearest, "ROWS_PER_TASK", 2000, raising=False)
    monkeypatch.setattr(nearest, "PAIRS_PER_TASK", 2000, raising=False)
    monkeypatch.setattr(nearest, "SPLIT_ABOVE", 8)
    xy = skewed_points(3000, seed=3)
    got = {r.id: r.k_dist for r in nearest.k_distance(frame(spark, xy), 8, tile=16).collect()}
    want = brute_k_distance(xy, 8)
    assert all(got[i] == want[i] for i in range(len(xy)))
    assert max(map(sum, seen)) > 20_000 and max(map(max, seen)) <= 4000


def test_k_distance_with_too_few_points_is_null(spark):
    got = nearest.k_distance(frame(spark, [(0, 0), (3, 4), (3, 4)]), 3).collect()
    assert {r.id: r.k_dist for r in got} == {0: 5.0, 1: 5.0, 2: 5.0}
    assert [r.k_dist for r in nearest.k_distance(frame(spark, [(0, 0), (1, 1)]), 3).collect()] == [None, None]


def test_nearest_other_is_sorted(spark):
    got = nearest.nearest_other(frame(spark, [(0, 0), (1, 0), (1, 0), (5, 0)])).collect()
    assert [(r.id, r.k_dist) for r in got] == [(1, 0.0), (2, 0.0), (0, 1.0), (3, 4.0)]


def test_ranks_are_global(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 97).alias("v"))
    got = ranking.global_rank(df, ["v", "id"]).toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(5000))
    assert list(zip(got.v, got.id)) == sorted(zip(got.v, got.id))


def test_ranges_of_a_skewed_column_are_even(spark, monkeypatch):
    n = 60_000
    value = F.when(F.col("id") % 5 < 3, 7.0).otherwise(F.exp(F.randn(4) * 3))
    df = spark.range(n).select("id", value.alias("v"))
    monkeypatch.setattr(ranking, "RANGE_BYTES", 30_000)
    ranked = ranking.global_rank(df, ["v", "id"])
    placed = ranking.ordered_ranges(df, ["v", "id"])
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 2 * min(sizes) and sum(sizes) == n
    rows = ranked.orderBy("rank").select("rank", "v", "id").collect()
    assert [r.rank for r in rows] == list(range(n)) and all((a.v, a.id) < (b.v, b.id) for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("q", [0.0, 0.73, 0.5, 1.0])
def test_quantiles_are_interpolated(spark, q):
    values = list(np.random.default_rng(5).normal(size=101))
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i long")
    ranked = ranking.global_rank(df, ["v", "i"])
    got = spark.range(1).select(ranking.interpolated_quantile(ranked, "v", q).alias("q")).first()["q"]
    assert got == pytest.approx(np.quantile(values, q))


@pytest.mark.parametrize("s", [7, 500])
def test_density_levels_equal_the_rolling_mean(spark, s):
    values = np.random.default_rng(2).exponential(size=300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, k_dist double")
    got = density.density_levels(df, s).toPandas().sort_values("rank")
    variation = np.diff(np.sort(values))
    smoothed = pd.Series(variation).rolling(s).mean().to_numpy()
    smoothed[: s - 1] = variation[: s - 1]
    assert np.allclose(got.variation, variation)
    assert np.allclose(got.smoothed, smoothed)
    assert list(got.in_level) == list(smoothed <= np.percentile(smoothed, 73))


def sequential_labels(xy, eps, min_pts):
    """The textbook algorithm in id order."""
    xy = np.asarray(xy, float)
    dx, dy = xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]
    near = dx * dx + dy * dy <= eps * eps
    core = near.sum(axis=1) >= min_pts
    labels = np.full(len(xy), -1)
    cluster = 0
    for i in range(len(xy)):
        if not core[i] or labels[i] != -1:
            continue
        stack = [i]
        labels[i] = cluster
        while stack:
            p = stack.pop()
            if core[p]:
                for q in np.flatnonzero(near[p] & (labels == -1)):
                    labels[q] = cluster
                    stack.append(q)
        cluster += 1
    return labels


def check_labels(spark, xy, eps, min_pts):
    got = {r.id: r.cluster for r in dbscan.dbscan(frame(spark, xy), eps, min_pts).collect()}
    want = sequential_labels(xy, eps, min_pts)
    assert [got[i] for i in range(len(xy))] == list(want)
    return want


def test_labels_of_skewed_points(spark):
    rng = np.random.default_rng(4)
    blobs = [rng.normal(c, 1.5, (150, 2)) for c in ((0, 0), (9, 1), (4, 12), (30, 30))]
    xy = np.vstack([np.full((400, 2), 2.0), *blobs, rng.uniform(-40, 40, (300, 2))])
    order = rng.permutation(len(xy))
    labels = check_labels(spark, xy[order], 1.2, 8)
    assert len(set(labels)) > 3 and (labels == -1).any()


def test_labels_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.normal(0, 6, (400, 2)))
    a = dbscan.dbscan(df, 1.0, 5)
    b = dbscan.dbscan(df.orderBy(F.rand(3)).repartition(7), 1.0, 5)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_dense_cells_link_only_within_the_radius(spark):
    """Two dense strips whose closest sites are just inside or just outside the radius."""
    for gap, clusters_expected in ((0.9999, 1), (1.0, 1), (1.0001, 2)):
        left = [(-0.3 * (i % 5) / 5, 0.01 * i) for i in range(40)]
        right = [(gap + 0.3 * (i % 5) / 5, 0.01 * i) for i in range(40)]
        labels = check_labels(spark, np.array(left + right), 1.0, 5)
        assert len(set(labels)) == clusters_expected


def test_labels_with_salted_joins_and_one_cluster_of_nearly_all_points(spark, monkeypatch):
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("inner", 3, False))
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(0, 0.8, (570, 2)), rng.uniform(-30, 30, (30, 2))])
    labels = check_labels(spark, xy, 0.7, 5)
    assert np.mean(np.array(labels) == 0) > 0.9


def test_no_core_points(spark):
    assert set(check_labels(spark, [(0, 0), (10, 10), (20, 20)], 1.0, 2)) == {-1}


def test_only_dense_points(spark):
    assert set(check_labels(spark, np.full((50, 2), 1.5), 1.0, 10)) == {0}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST_ROWS", limit)
    # Without broadcasts every lookup is a written join, so a shorter chain keeps that case quick.
    length = 200 if limit else 12
    chain = [(i, i + 1) for i in range(length)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (7, 6)], "a long, b long")
    nodes = spark.range(length + 1).union(spark.range(1000, 1300)).union(spark.range(5000, 5002)).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in components.connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(length + 1)} == {0}
    assert {got[i] for i in range(1000, 1300)} == {1000}
    assert got[5000] == 5000 and got[5001] == 5001


def test_cluster_reports_keep_all_points(spark):
    rows = [(i, float(i), float(-i), 0 if i < 25 else 1 if i < 28 else -1) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, Latitude double, Longitude double, cluster int")
    report = clusters.cluster_report(df, page_size=10).orderBy("id", "page").collect()
    assert [(r.id, r.page, len(r.points), r.crime_count) for r in report] == [
        (0, 0, 10, 25), (0, 1, 10, 25), (0, 2, 5, 25), (1, 0, 3, 3),
    ]
    assert [p.Latitude for r in report for p in r.points] == [float(i) for i in range(28)]
    assert report[3].centroid.lat == 26.0
    assert [(r.cluster, r.n) for r in clusters.label_counts(df).collect()] == [(0, 25), (1, 3), (-1, 2)]
    assert tuple(clusters.label_totals(df).first()) == (2, 2)
    assert [r.cluster for r in clusters.cluster_ids(df).collect()] == [0, 1]
    assert clusters.members_of(df, 1).count() == 3
