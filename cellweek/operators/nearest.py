"""k-th nearest neighbour distance of every point, exact and safe for dense spots."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweek.operators.skew import BROADCAST_ROWS, lookup_join
from cellweek.operators.tiles import (
    BOX,
    FANOUT,
    ancestors,
    distinct_sites,
    farthest_squared,
    height_of,
    leaf_nodes,
    nearest_squared,
    nodes_at,
    tile_sites,
)
from cellweek.schema import NEIGHBOURS
from cellweek.sources.scratch import materialize

# A query box with more candidate nodes than this is replaced by its single sites. This
# splits the work and drops no candidate.
SPLIT_ABOVE = 256

TILES_PER_TASK = 100
# Rows that a task gets to sort by query, and pairs of sites that are looked through for them.
ROWS_PER_TASK = 500_000
PAIRS_PER_TASK = 1_000_000

QUERY = ["q_i", "q_j", "q_site"]


def _prefixed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def _by_query(df: DataFrame, most: int, per_task: int, keys: list[str]) -> DataFrame:
    """The rows, `most` at most, dealt out by query to as many tasks as they need.

    The number is set here, because rows are few and small before they meet the nodes and sites
    that multiply them: from the bytes at that point Spark would choose a single task.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-most // per_task)), *keys)


def _prune(frontier: DataFrame, k: int) -> DataFrame:
    """Drop nodes that cannot hold one of the k nearest points of their query box.

    The bound of a query is the smallest radius at which wholly covered nodes already hold
    k points; it stays as _bound, and _width is the number of nodes a query keeps.
    """
    measured = frontier.withColumns(
        {"_near": nearest_squared("q_", "r_"), "_far": farthest_squared("q_", "r_")}
    )
    by_far = Window.partitionBy(*QUERY).orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)
    covered = F.sum("r_n").over(by_far)
    bound = F.min(F.when(F.col("_covered") >= k, F.col("_far"))).over(Window.partitionBy(*QUERY))
    return (
        measured.withColumn("_covered", covered)
        .withColumn("_bound", bound)
        .where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound")))
        .drop("_near", "_far", "_covered")
        .withColumn("_width", F.count(F.lit(1)).over(Window.partitionBy(*QUERY)))
    )


def _split_wide(frontier: DataFrame, sites: DataFrame, size: int, k: int) -> DataFrame:
    """Replace query boxes that kept too many nodes by their sites, and prune those again."""
    wide = F.col("q_site").isNull() & (F.col("_width") > SPLIT_ABOVE)
    rows = frontier.where(wide).count()
    if not rows:
        return frontier
    members = sites.select(
        F.col("slab").alias("q_i"),
        F.col("tile").alias("q_j"),
        F.col("site").alias("q_site"),
        F.col("x").alias("q_min_x"),
        F.col("x").alias("q_max_x"),
        F.col("y").alias("q_min_y"),
        F.col("y").alias("q_max_y"),
    )
    nodes = [c for c in frontier.columns if c.startswith("r_")]
    single = frontier.where(wide).select("q_i", "q_j", *nodes).join(members, ["q_i", "q_j"])
    single = _by_query(single, rows * size, ROWS_PER_TASK, QUERY)
    pruned = materialize(_prune(single, k).select(*frontier.columns))
    return frontier.where(~wide).unionByName(pruned)


def _leaf_candidates(tiled: DataFrame, extent: list[int], size: int, k: int) -> DataFrame:
    """Pairs of query (box or single site) and leaf that may hold one of its k nearest.

    _bound is the squared radius around the query that surely holds k points. Every level is
    stored, so that a task holds the rows of one level only and the next one knows their number.
    """
    leaves = materialize(leaf_nodes(tiled))
    frontier = _prefixed(leaves, "q_", ["i", "j", *BOX]).withColumns(
        {
            "q_site": F.lit(None).cast("bigint"),
            "r_i": F.lit(0).cast("bigint"),
            "r_j": F.lit(0).cast("bigint"),
            "_bound": F.lit(None).cast("double"),
        }
    )
    for level in reversed(range(height_of(extent))):
        children = _prefixed(ancestors(leaves, level), "r_", ["i", "j", "n", *BOX]).withColumns(
            {"p_i": F.floor(F.col("r_i") / FANOUT), "p_j": F.floor(F.col("r_j") / FANOUT)}
        )
        parents = frontier.select(
            F.col("r_i").alias("p_i"), F.col("r_j").alias("p_j"), *QUERY, *["q_" + b for b in BOX]
        )
        # All queries share the few nodes of the upper levels, which would make them hot keys.
        if nodes_at(extent, level) <= BROADCAST_ROWS:
            children = F.broadcast(children)
        expanded = parents.join(children, ["p_i", "p_j"]).drop("p_i", "p_j")
        expanded = _by_query(expanded, frontier.count() * FANOUT * FANOUT, ROWS_PER_TASK, QUERY)
        frontier = materialize(_prune(expanded, k))
        if level == 0 or nodes_at(extent, level) > SPLIT_ABOVE:
            frontier = _split_wide(frontier, tiled, size, k)
    return frontier.select(*QUERY, *["q_" + b for b in BOX], "r_i", "r_j", "_bound")


def _tile_distances(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """k-th smallest weighted distance of each own site among the candidates of a tile."""
        import numpy as np

        x, y, n = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()
        own = pdf["own"].to_numpy()
        dx = x[own][:, None] - x[None, :]
        dy = y[own][:, None] - y[None, :]
        d2 = dx * dx + dy * dy
        width = min(k, d2.shape[1])
        pick = np.argpartition(d2, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(d2, pick, axis=1)
        order = np.argsort(near, axis=1)
        near = np.take_along_axis(near, order, axis=1)
        count = np.cumsum(np.take_along_axis(n[pick], order, axis=1), axis=1)
        enough = count >= k
        at = enough.argmax(axis=1)
        out = near[np.arange(len(near)), at]
        found = enough.any(axis=1)
        return pd.DataFrame({"x": x[own][found], "y": y[own][found], "d2": out[found]})

    return run


def site_distances(sites: DataFrame, k: int, tile: int | None = None) -> DataFrame:
    """x, y, d2: squared distance from each site to its k-th nearest point, itself included.

    Sites with fewer than k points in total have no row.
    """
    size = tile or max(32, k)
    tiled, extent = tile_sites(sites, size)
    candidates = _leaf_candidates(tiled, extent, size, k)
    point = {f"s_{n}_{a}": F.col(a) for n in ("min", "max") for a in ("x", "y")}
    members = (
        tiled.withColumns(point)
        .withColumnRenamed("slab", "r_i")
        .withColumnRenamed("tile", "r_j")
        .select("r_i", "r_j", "x", "y", "n", *point)
    )
    near = nearest_squared("q_", "s_")
    reachable = (
        candidates.join(members, ["r_i", "r_j"])
        .withColumn("_d2", near)
        .where(F.col("_bound").isNull() | (F.col("_d2") <= F.col("_bound")))
    )
    boxed = reachable.where(F.col("q_site").isNull())
    own = (F.col("q_i") == F.col("r_i")) & (F.col("q_j") == F.col("r_j"))
    # Rows are few but each tile costs Python time, so the task count follows the tiles.
    tasks = max(sites.sparkSession.sparkContext.defaultParallelism, nodes_at(extent, 0) // TILES_PER_TASK)
    from_tiles = (
        boxed.select("q_i", "q_j", "x", "y", "n", own.alias("own"))
        .repartition(tasks, "q_i", "q_j")
        .groupBy("q_i", "q_j")
        .applyInPandas(_tile_distances(k), "x double, y double, d2 double")
    )
    # For a single site the distance to its box is the distance to the site itself.
    by_distance = Window.partitionBy("q_site").orderBy("_d2").rangeBetween(Window.unboundedPreceding, 0)
    pairs = candidates.where(F.col("q_site").isNotNull()).count() * size
    from_sites = (
        _by_query(reachable.where(F.col("q_site").isNotNull()), pairs, PAIRS_PER_TASK, ["q_site"])
        .withColumn("_count", F.sum("n").over(by_distance))
        .where(F.col("_count") >= k)
        .groupBy("q_min_x", "q_min_y")
        .agg(F.min("_d2").alias("d2"))
        .select(F.col("q_min_x").alias("x"), F.col("q_min_y").alias("y"), "d2")
    )
    return from_tiles.unionByName(from_sites)


def k_distance(points: DataFrame, k: int = NEIGHBOURS, tile: int | None = None) -> DataFrame:
    """id, x, y, k_dist of every point with coordinates; NULL when there are fewer than k points.

    Points at the same location share one search.
    """
    found = site_distances(distinct_sites(points), k, tile)
    usable = points.dropna(subset=["x", "y"]).where(~F.isnan("x") & ~F.isnan("y"))
    joined = lookup_join(usable.select("id", "x", "y"), found, ["x", "y"], "left")
    return joined.select("id", "x", "y", F.sqrt("d2").alias("k_dist"))


def nearest_other(points: DataFrame) -> DataFrame:
    """id, k_dist: distance to the nearest other point, in ascending order."""
    return k_distance(points, 2).select("id", "k_dist").orderBy("k_dist", "id")
