"""Exact density-based clustering on a grid, without listing the pairs of dense cells.

Cells are small enough that all their points are neighbours (Gunawan, 2013; Gan and Tao,
2015). A cell with min_pts points or more is dense: all its points are core and one node of
the cluster graph stands for them. Distances are only computed

* between points of sparse cells, which hold fewer than min_pts points each,
* from such points to dense cells, where sub-boxes that are wholly inside or outside the
  radius are counted or skipped as one,
* between two neighbouring dense cells whose connection still matters, by comparing ever
  smaller boxes until each pair is decided.

The labels equal those of the sequential algorithm run in id order: clusters are numbered by
their smallest core id and a border point takes the smallest adjacent cluster.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweek.operators.components import connected_components
from cellweek.operators.ranking import global_rank
from cellweek.operators.skew import lookup_join
from cellweek.operators.tiles import BOX, distinct_sites, farthest_squared, nearest_squared
from cellweek.schema import EPS, MIN_POINTS
from cellweek.sources.scratch import materialize

# Cell side in units of eps: a diagonal stays below 1 and three cells apart is beyond reach.
SIDE = 0.7
REACH = 2
SUB = 8
REFINE = 4
CELL = ["cx", "cy"]
SUBBOX = ["cx", "cy", "bx", "by"]

OFFSETS = [(i, j) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1) if (i, j) != (0, 0)]
# One direction of every pair of neighbouring cells.
HALF = [o for o in OFFSETS if o > (0, 0)]


def _index(axis: str, side: float) -> Column:
    return F.floor(F.col(axis) / F.lit(side)).cast("bigint")


def _around(df: DataFrame, offsets) -> DataFrame:
    """One row per neighbouring cell, with that cell's index as nx, ny."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    return (
        df.withColumn("_o", F.explode(steps))
        .withColumns({"nx": F.col("cx") + F.col("_o.i"), "ny": F.col("cy") + F.col("_o.j")})
        .drop("_o")
    )


def _box() -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]


def _boxes(sites: DataFrame, side: float) -> DataFrame:
    """Counts and extents of the sub-boxes of every cell, and two of their sites.

    All cell figures follow from these boxes, so the sites are aggregated only once.
    """
    at = F.struct("x", "y")
    return (
        sites.withColumns({"bx": _index("x", side / SUB), "by": _index("y", side / SUB)})
        .groupBy(*SUBBOX)
        .agg(
            F.sum("n").alias("box_n"),
            F.min("site").alias("box_site"),
            *_box(),
            F.min(at).alias("low"),
            F.max(at).alias("high"),
        )
    )


def _dense_cells(boxes: DataFrame, min_pts: int) -> DataFrame:
    """Cells with at least min_pts points. tips holds real sites of all their boxes.

    A cell has at most (SUB + 1)^2 boxes, so the array is bounded.
    """
    return (
        boxes.groupBy(*CELL)
        .agg(
            F.sum("box_n").alias("cell_n"),
            F.min("box_site").alias("label"),
            *[F.min(c).alias(c) for c in ("min_x", "min_y")],
            *[F.max(c).alias(c) for c in ("max_x", "max_y")],
            F.flatten(F.collect_list(F.array("low", "high"))).alias("tips"),
        )
        .where(F.col("cell_n") >= min_pts)
    )


def _d2(a, b) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return dx * dx + dy * dy


def _renamed(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def _as_point_box(prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}_{a}": F.col(a) for n in ("min", "max") for a in ("x", "y")}


def _sparse_pairs(sparse: DataFrame, eps2: float) -> DataFrame:
    """Neighbouring pairs of sites of different sparse cells, each pair once."""
    columns = ["site", "cx", "cy", "x", "y", "n"]
    left = _around(sparse.select(*columns), HALF)
    right = _renamed(sparse, "o_", columns)
    joined = left.join(right, (F.col("nx") == F.col("o_cx")) & (F.col("ny") == F.col("o_cy")))
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    return joined.where(dx * dx + dy * dy <= eps2).select(
        "site", "cx", "cy", "n", "o_site", "o_cx", "o_cy", "o_n"
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    forth = pairs.select("site", "o_site", "o_cx", "o_cy", "o_n")
    back = pairs.select(
        F.col("o_site").alias("site"),
        F.col("site").alias("o_site"),
        F.col("cx").alias("o_cx"),
        F.col("cy").alias("o_cy"),
        F.col("n").alias("o_n"),
    )
    return forth.unionByName(back)


def _touches(sites, boxes, sparse, dense, pairs, eps2: float, min_pts: int, side: float):
    """Links of sparse sites to dense cells, and the neighbour count of each sparse site.

    Returns touch(site, cx, cy) with the dense cell, and counts(site, total) where total is
    exact below min_pts and at least min_pts otherwise.
    """
    target = _renamed(dense, "d_", BOX + CELL)
    near = (
        _around(sparse.select("site", "cx", "cy", "x", "y"), OFFSETS)
        .join(target, (F.col("nx") == F.col("d_cx")) & (F.col("ny") == F.col("d_cy")))
        .withColumns(_as_point_box("p_"))
        .where(nearest_squared("p_", "d_") <= eps2)
        .select("site", "x", "y", F.col("nx").alias("cx"), F.col("ny").alias("cy"))
    )
    parts = boxes.select(*SUBBOX, "box_n", *[F.col(b).alias("d_" + b) for b in BOX])
    measured = materialize(
        near.join(parts, CELL)
        .withColumns(_as_point_box("p_"))
        .where(nearest_squared("p_", "d_") <= eps2)
        .withColumn("inside", farthest_squared("p_", "d_") <= eps2)
        .select("site", "x", "y", *SUBBOX, "box_n", "inside")
    )
    inside = measured.where("inside").groupBy("site", *CELL).agg(F.sum("box_n").alias("sure"))
    own = sparse.select("site", F.sum("n").over(Window.partitionBy(*CELL)).alias("k"))
    known = (
        own.unionByName(_both_ways(pairs).select("site", F.col("o_n").alias("k")))
        .unionByName(inside.select("site", F.col("sure").alias("k")))
        .groupBy("site")
        .agg(F.sum("k").alias("total"))
    )
    open_boxes = (
        measured.where("NOT inside")
        .join(inside, ["site", *CELL], "left")
        .join(known, "site")
        .where(F.col("sure").isNull() | (F.col("total") < min_pts))
        .select("site", F.col("x").alias("p_x"), F.col("y").alias("p_y"), *SUBBOX)
    )
    # A box meets only sites of nearby sparse cells, so at most 24 * min_pts rows match one.
    sub = {"bx": _index("x", side / SUB), "by": _index("y", side / SUB)}
    dx, dy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    counted = materialize(
        lookup_join(sites.drop("site").withColumns(sub), open_boxes, SUBBOX)
        .where(dx * dx + dy * dy <= eps2)
        .groupBy("site", *CELL)
        .agg(F.sum("n").alias("k"))
    )
    touch = inside.select("site", *CELL).unionByName(counted.select("site", *CELL)).distinct()
    counts = (
        known.unionByName(counted.select("site", F.col("k").alias("total")))
        .groupBy("site")
        .agg(F.sum("total").alias("total"))
    )
    return materialize(touch), counts


def _dense_links(dense: DataFrame, eps2: float) -> DataFrame:
    """Pairs of neighbouring dense cells within possible reach, and whether they surely link."""
    columns = ["label", "cx", "cy", "tips", *BOX]
    left = _around(_renamed(dense, "a_", columns).withColumns({"cx": F.col("a_cx"), "cy": F.col("a_cy")}), HALF)
    right = _renamed(dense, "b_", columns)
    joined = left.join(right, (F.col("nx") == F.col("b_cx")) & (F.col("ny") == F.col("b_cy")))
    tip = F.exists("a_tips", lambda a: F.exists("b_tips", lambda b: _d2(a, b) <= eps2))
    return joined.where(nearest_squared("a_", "b_") <= eps2).select(
        "a_label", "b_label", "a_cx", "a_cy", "b_cx", "b_cy",
        ((farthest_squared("a_", "b_") <= eps2) | tip).alias("linked"),
    )


def _refined_links(sites: DataFrame, unsure: DataFrame, eps2: float, side: float) -> DataFrame:
    """Decide the remaining pairs of dense cells exactly; returns edges (a, b) of labels.

    Each round splits the boxes of the open pairs by REFINE and drops pairs that are out of
    reach or already linked. A box with a single site is decided, so the rounds end.
    """
    cells = unsure.select(F.col("a_cx").alias("cx"), F.col("a_cy").alias("cy")).unionByName(
        unsure.select(F.col("b_cx").alias("cx"), F.col("b_cy").alias("cy"))
    )
    members = materialize(lookup_join(sites, cells.distinct(), CELL).select("x", "y"))
    pairs = unsure.select(
        F.col("a_label").alias("a"), F.col("b_label").alias("b"),
        F.col("a_cx").alias("pa_x"), F.col("a_cy").alias("pa_y"),
        F.col("b_cx").alias("pb_x"), F.col("b_cy").alias("pb_y"),
    )
    links = None
    while not pairs.isEmpty():
        side = side / REFINE
        boxes = (
            members.groupBy(_index("x", side).alias("ix"), _index("y", side).alias("iy"))
            .agg(*_box())
            .withColumns({"px": F.floor(F.col("ix") / REFINE), "py": F.floor(F.col("iy") / REFINE)})
        )
        columns = ["px", "py", "ix", "iy", *BOX]
        a, b = _renamed(boxes, "a_", columns), _renamed(boxes, "b_", columns)
        tried = materialize(
            pairs.join(a, (F.col("pa_x") == F.col("a_px")) & (F.col("pa_y") == F.col("a_py")))
            .join(b, (F.col("pb_x") == F.col("b_px")) & (F.col("pb_y") == F.col("b_py")))
            .where(nearest_squared("a_", "b_") <= eps2)
            .select("a", "b", "a_ix", "a_iy", "b_ix", "b_iy", (farthest_squared("a_", "b_") <= eps2).alias("hit"))
        )
        hits = tried.where("hit").select("a", "b").distinct()
        links = hits if links is None else links.unionByName(hits)
        # Two long clusters can put most boxes on one pair, so the lookup cuts hot pairs.
        open_pairs = lookup_join(tried.where("NOT hit"), hits.withColumn("_found", F.lit(True)), ["a", "b"], "left")
        pairs = materialize(
            open_pairs.where("_found IS NULL")
            .select(
                "a", "b",
                F.col("a_ix").alias("pa_x"), F.col("a_iy").alias("pa_y"),
                F.col("b_ix").alias("pb_x"), F.col("b_iy").alias("pb_y"),
            )
        )
    return links


def dbscan(points: DataFrame, eps: float = EPS, min_pts: int = MIN_POINTS) -> DataFrame:
    """id, cluster for every point of points(id, x, y); -1 is noise."""
    eps2, side = float(eps) * float(eps), float(eps) * SIDE
    # A point without both coordinates gets no cell and so stays noise.
    placed = ~F.isnan("x") & ~F.isnan("y")
    located = points.select("id", *(F.when(placed, F.col(c)).alias(c) for c in ("x", "y"))).withColumns(
        {"cx": _index("x", side), "cy": _index("y", side)}
    )
    sites = materialize(
        distinct_sites(points).withColumns({"cx": _index("x", side), "cy": _index("y", side)})
    )
    boxes = materialize(_boxes(sites, side))
    dense = materialize(_dense_cells(boxes, min_pts))
    marks = dense.select(*CELL, F.lit(True).alias("_dense"))
    flagged = lookup_join(sites, marks, CELL, "left", stored=True)
    sparse = materialize(flagged.where(F.col("_dense").isNull()).drop("_dense"))
    pairs = materialize(_sparse_pairs(sparse, eps2))
    touch, counts = _touches(sites, boxes, sparse, dense, pairs, eps2, min_pts, side)

    core = materialize(
        sparse.join(counts.where(F.col("total") >= min_pts).select("site"), "site").select("site", *CELL)
    )
    nodes = materialize(
        dense.select(*CELL, "label", F.lit(True).alias("is_dense")).unionByName(
            core.groupBy(*CELL).agg(F.min("site").alias("label"), F.lit(False).alias("is_dense"))
        )
    )
    label_of = nodes.select(*CELL, "label")
    core_label = core.join(label_of, CELL).select("site", F.col("label").alias("a"))
    across = (
        pairs.select("site", "o_site")
        .join(core_label, "site")
        .join(core_label.select(F.col("site").alias("o_site"), F.col("a").alias("b")), "o_site")
        .select("a", "b")
    )
    to_dense = touch.join(core_label, "site").join(dense.select(*CELL, F.col("label").alias("b")), CELL).select("a", "b")
    links = materialize(_dense_links(dense, eps2))
    sure = links.where("linked").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    roots = connected_components(
        nodes.select(F.col("label").alias("node")), across.unionByName(to_dense).unionByName(sure)
    )
    unsure = links.where("NOT linked")
    if not unsure.isEmpty():
        for end in ("a", "b"):
            named = roots.select(F.col("node").alias(f"{end}_label"), F.col("root").alias(f"{end}_root"))
            unsure = unsure.join(named, f"{end}_label")
        apart = materialize(
            unsure.where("a_root <> b_root").select(
                F.col("a_root").alias("a_label"), F.col("b_root").alias("b_label"), "a_cx", "a_cy", "b_cx", "b_cy"
            )
        )
        more = _refined_links(sites, apart, eps2, side)
        if more is not None:
            upper = connected_components(roots.select(F.col("root").alias("node")).distinct(), more)
            roots = lookup_join(
                roots.withColumnRenamed("root", "_lower"),
                upper.withColumnRenamed("node", "_lower"),
                ["_lower"],
            ).select("node", "root")

    numbers = global_rank(roots.select("root").distinct(), ["root"], "cluster")
    clusters = lookup_join(roots, numbers.select("root", "cluster"), ["root"]).select(F.col("node").alias("label"), F.col("cluster").cast("int"))
    cell_cluster = materialize(nodes.join(clusters, "label").select(*CELL, "is_dense", "cluster"))
    return _assign(located, sparse, core, pairs, touch, cell_cluster)


def _assign(located, sparse, core, pairs, touch, cell_cluster) -> DataFrame:
    """Labels of all points from the clusters of the cells.

    Points of dense cells need only their cell. A site of a sparse cell takes the smallest
    cluster among its own cell, the core sites near it and the dense cells it touches.
    """
    own = sparse.select("site", *CELL)
    beside = (
        _both_ways(pairs)
        .select("site", "o_site", F.col("o_cx").alias("cx"), F.col("o_cy").alias("cy"))
        .join(core.select(F.col("site").alias("o_site")), "o_site")
        .select("site", *CELL)
    )
    sparse_cluster = (
        own.unionByName(beside)
        .unionByName(touch)
        .join(cell_cluster, CELL)
        .groupBy("site")
        .agg(F.min("cluster").alias("_sparse"))
        .join(sparse.select("site", F.col("x").alias("_x"), F.col("y").alias("_y")), "site")
        .drop("site")
    )
    dense_cluster = cell_cluster.where("is_dense").select(*CELL, F.col("cluster").alias("_cluster"))
    by_cell = lookup_join(located, dense_cluster, CELL, "left", stored=True)
    # Points of dense cells are done; a NULL key keeps them out of the second lookup.
    rest = F.col("_cluster").isNull()
    by_site = lookup_join(
        by_cell.withColumns({"_x": F.when(rest, F.col("x")), "_y": F.when(rest, F.col("y"))}),
        sparse_cluster,
        ["_x", "_y"],
        "left",
    )
    return by_site.select("id", F.coalesce("_cluster", "_sparse", F.lit(-1)).alias("cluster"))
