"""Connected components of an edge table, labelled by their smallest node."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.operators.skew import BROADCAST_ROWS, lookup_join, salted_join
from cellweek.sources.scratch import materialize


def _follow(df: DataFrame, column: str, parents: DataFrame, small: bool) -> DataFrame:
    """Replace a node column by its parent where it has one."""
    step = parents.select(F.col("node").alias(column), F.col("parent").alias("_parent"))
    moved = df.join(F.broadcast(step), [column], "left") if small else salted_join(df, step, [column], "left")
    out = moved.withColumn(column, F.coalesce("_parent", F.col(column))).drop("_parent").select(*df.columns)
    return out if small else materialize(out)


def _priority(node: str, seed: int) -> Column:
    return F.struct(F.xxhash64(F.col(node), F.lit(seed)).alias("h"), F.col(node).alias("node"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root for every row of nodes(node); edges(a, b) are undirected.

    Each round hooks every node to the neighbour that comes first in a random order, follows
    the hooks four steps and contracts the graph. The order is new in every round, so hooks
    form short chains whatever the ids look like and each round removes a constant share of
    the nodes. The first neighbour is found with map-side combine and the lookups cut hot
    nodes, so a hub with most of the edges is no bottleneck.
    """
    left = materialize(edges.where("a <> b").select("a", "b").distinct())
    n_edges = left.count()
    rounds = []
    while n_edges > 0:
        # A graph has at most twice as many nodes as edges, which bounds the broadcast.
        small = 2 * n_edges <= BROADCAST_ROWS
        seed = len(rounds)
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = (
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(_priority("b", seed)).alias("first"))
            .select("node", F.least("first", _priority("node", seed))["node"].alias("parent"))
        )
        if not small:
            hooks = materialize(hooks)
        twice = _follow(hooks, "parent", hooks, small)
        parents = materialize(_follow(twice, "parent", twice, small))
        rounds.append((parents, small))
        moved = _follow(_follow(left, "a", parents, small), "b", parents, small)
        left = materialize(moved.where("a <> b").distinct())
        n_edges = left.count()
    found = nodes.select("node", F.col("node").alias("root"))
    for parents, small in rounds:
        found = _follow(found, "root", parents, small)
    smallest = found.groupBy("root").agg(F.min("node").alias("_least"))
    found = lookup_join(found, smallest, ["root"])
    return materialize(found.select("node", F.col("_least").alias("root")))
