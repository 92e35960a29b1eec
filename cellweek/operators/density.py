"""Density levels: smoothed change of the sorted k-distances, cut at a quantile."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweek.operators.ranking import global_rank, interpolated_quantile
from cellweek.schema import OMEGA, SMOOTHING
from cellweek.sources.scratch import materialize


def density_variation(k_dist: DataFrame, s: int = SMOOTHING) -> DataFrame:
    """rank, id, k_dist, variation, smoothed for the n - 1 gaps of the ascending k-distances.

    The trailing mean of s consecutive differences is the difference of two sorted values s
    places apart, so it needs one equi-join on ranks instead of a global window. The first
    s - 1 gaps keep their raw value.
    """
    ranked = materialize(global_rank(k_dist.select("id", "k_dist"), ["k_dist", "id"]))
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("k_dist").alias("_next"))
    behind = ranked.select((F.col("rank") + s - 1).alias("rank"), F.col("k_dist").alias("_behind"))
    gaps = ranked.join(following, "rank").join(behind, "rank", "left")
    raw = F.col("_next") - F.col("k_dist")
    mean = F.when(F.col("rank") < s - 1, raw).otherwise((F.col("_next") - F.col("_behind")) / s)
    return gaps.select("rank", "id", "k_dist", raw.alias("variation"), mean.alias("smoothed"))


def density_levels(k_dist: DataFrame, s: int = SMOOTHING, omega: float = OMEGA) -> DataFrame:
    """The variations with in_level: smoothed is at most its (1 + omega) quantile."""
    varied = materialize(density_variation(k_dist, s))
    ordered = materialize(global_rank(varied.select("smoothed", "rank"), ["smoothed", "rank"], "place"))
    bound = interpolated_quantile(ordered, "smoothed", 1 + omega, "place")
    return varied.withColumn("in_level", F.col("smoothed") <= bound)
