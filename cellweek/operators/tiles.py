"""Balanced spatial tiles: a packed tree over distinct sites, built by two global sorts.

Sites are cut into vertical slabs of equal count, and each slab into tiles of equal count
(sort-tile-recursive packing, Leutenegger et al., 1997). A tile holds at most `size` sites
however the data is skewed, so a city with a third of all rows simply gets more tiles.
Coarser levels merge 4 x 4 neighbouring tiles until one node is left.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.operators.ranking import global_rank
from cellweek.sources.scratch import materialize

FANOUT = 4
BOX = ["min_x", "max_x", "min_y", "max_y"]


def distinct_sites(points: DataFrame) -> DataFrame:
    """x, y, n and the smallest id of the points at each distinct location."""
    usable = ~F.isnan("x") & ~F.isnan("y")
    return (
        points.dropna(subset=["x", "y"])
        .where(usable)
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("site"))
    )


def tile_sites(sites: DataFrame, size: int) -> tuple[DataFrame, list[int]]:
    """Adds slab and tile, and returns the largest extent of the tile grid in both directions.

    Two range shuffles; slab sizes are multiples of the tile size.
    """
    sites = materialize(sites)
    total = sites.count()
    height = max(1, round((total / size) ** 0.5))
    per_slab = height * size
    by_x = global_rank(sites, ["x", "y"], "_rx").withColumn("slab", F.floor(F.col("_rx") / per_slab))
    by_y = global_rank(by_x.drop("_rx"), ["slab", "y", "x"], "_ry")
    tile = F.floor((F.col("_ry") - F.col("slab") * per_slab) / size)
    return by_y.withColumn("tile", tile).drop("_ry"), [-(-total // per_slab), height]


def leaf_nodes(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy(F.col("slab").alias("i"), F.col("tile").alias("j")).agg(
        F.sum("n").alias("n"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def ancestors(leaves: DataFrame, levels_up: int) -> DataFrame:
    """Nodes some levels above the leaves; the leaves themselves for zero."""
    if levels_up == 0:
        return leaves
    width = FANOUT**levels_up
    return leaves.groupBy(F.floor(F.col("i") / width).alias("i"), F.floor(F.col("j") / width).alias("j")).agg(
        F.sum("n").alias("n"),
        F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_y").alias("max_y"),
    )


def height_of(extent: list[int]) -> int:
    """Levels between the single root and the leaves."""
    levels = 0
    while any(FANOUT**levels < e for e in extent):
        levels += 1
    return levels


def nodes_at(extent: list[int], levels_up: int) -> int:
    """Upper bound of the number of nodes on a level."""
    width = FANOUT**levels_up
    return -(-extent[0] // width) * -(-extent[1] // width)


def nearest_squared(a: str, b: str) -> Column:
    """Smallest squared distance between any two points of two boxes.

    Subtraction, squaring and addition are monotone in floating point, so this bound holds
    exactly for the computed distances of the points inside.
    """

    def gap(axis: str) -> Column:
        right = F.col(f"{b}min_{axis}") - F.col(f"{a}max_{axis}")
        left = F.col(f"{a}min_{axis}") - F.col(f"{b}max_{axis}")
        return F.greatest(right, left, F.lit(0.0))

    return gap("x") * gap("x") + gap("y") * gap("y")


def farthest_squared(a: str, b: str) -> Column:
    """Largest squared distance between any two points of two boxes."""

    def reach(axis: str) -> Column:
        right = F.col(f"{b}max_{axis}") - F.col(f"{a}min_{axis}")
        left = F.col(f"{a}max_{axis}") - F.col(f"{b}min_{axis}")
        return F.greatest(right, left)

    return reach("x") * reach("x") + reach("y") * reach("y")
