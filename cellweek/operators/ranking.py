"""Global ranks and order statistics without moving all rows to one partition."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweek.operators.skew import stored_bytes
from cellweek.sources.scratch import materialize

# Stored bytes of one range partition.
RANGE_BYTES = 32 * 1024 * 1024
# A monotonically increasing id holds the partition above and the position below this bit.
_POSITION_BITS = 33


def ordered_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The stored rows in even ranges, sorted, with _place: the partition and the position there.

    The rows are written first: their stored size sets the number of partitions, and the sample
    that finds the splitters reads the stored rows instead of computing them once more. The
    splitters take all order columns, so many equal values in the first one do no harm.
    """
    stored = materialize(df)
    parts = max(1, math.ceil(stored_bytes(stored) / RANGE_BYTES))
    ranges = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranges.withColumn("_place", F.monotonically_increasing_id()))


def global_rank(df: DataFrame, order: list[str], into: str = "rank") -> DataFrame:
    """Adds the 0-based rank of every row in the order of the given columns.

    Rows are range partitioned and sorted inside their partitions; the rank is the position
    there plus the sizes of the partitions before it. The offsets table has one row per
    partition. The order columns should be unique together, so that ties cannot fill a
    partition and the rank is stable.
    """
    placed = ordered_ranges(df, order)
    part = F.shiftright("_place", _POSITION_BITS)
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", before.alias("_before"))
    )
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(into, F.col("_before") + position)
        .drop("_part", "_before", "_place")
    )


def interpolated_quantile(ranked: DataFrame, value: str, q: float, rank: str = "rank") -> Column:
    """Scalar subquery: the linearly interpolated q-quantile of a column that carries its rank.

    Only the two rows around the quantile are read back, unlike the percentile aggregate,
    which would keep every distinct value in one task.
    """
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    at = (n - 1) * F.lit(float(q))
    around = ranked.where(F.col(rank).between(F.floor(at), F.ceil(at)))
    low, high = F.min_by(value, rank), F.max_by(value, rank)
    return around.agg((low + (high - low) * (F.max(at) - F.min(rank))).alias("q")).scalar()
