"""Join of many fact rows to a lookup table, safe for hot keys and large lookups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweek.sources.scratch import materialize

# Lookups within both limits are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot when it holds more than 1/SLICES of the fact rows, so at most SLICES are hot.
SLICES = 1000
# Keys that the frequent-items sketch tracks. Its counts err by about 3.5 / TRACKED of all rows
# at most, well below a hot key's share, so no hot key is missed.
TRACKED = 16_384


def _missing(keys: list[str]) -> Column:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return missing


def _hashed(df: DataFrame, keys: list[str], like: DataFrame) -> Column:
    """Hash of the keys in the types of another table, so that keys that join have one hash."""
    parts = []
    for k in keys:
        kind = like.schema[k].dataType
        part = F.col(k) if df.schema[k].dataType == kind else F.col(k).try_cast(kind)
        # 0.0 and -0.0 join, but differ in their bits.
        parts.append(part + F.lit(0).cast(kind) if isinstance(kind, T.FractionalType) else part)
    return F.xxhash64(*parts)


def _salt(keys: list[str], columns: list[str]) -> Column:
    spread = F.xxhash64(*columns)
    slices = F.when(_missing(keys), F.lit(SLICES)).otherwise(F.coalesce("_slices", F.lit(1)))
    return F.pmod(spread, slices)


def hot_keys(facts: DataFrame, keys: list[str]) -> DataFrame:
    """_key, _slices: hashes of the keys with more than 1/SLICES of all rows, and the slices to cut them into.

    Each task leaves one mergeable sketch of its frequent keys, so no key is shuffled. A key of a
    little less than that share may be cut as well, which changes no result. Keys with a NULL
    match nothing and are spread without a sketch.
    """
    named = facts.select(F.when(~_missing(keys), _hashed(facts, keys, facts)).alias("_key"))
    seen = named.agg(
        F.expr(f"approx_top_k(_key, {2 * SLICES}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_total")
    )
    return (
        seen.select("_total", F.explode("_top").alias("_top"))
        .select(F.col("_top.item").alias("_key"), F.ceil(F.col("_top.count") * SLICES / F.col("_total")).alias("_slices"))
        .where(F.col("_key").isNotNull() & (F.col("_slices") > 1))
    )


def salted_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Shuffle join in which each hot key is cut into slices on the fact side.

    The hot-key table has at most 2 * SLICES rows by its definition, so it is safe to broadcast. It
    is written first, so that the returned plan holds the facts once and joins can be chained.
    The salt is a hash of the row, so a re-run task puts every row into the same slice.
    """
    hot = F.broadcast(materialize(hot_keys(facts, keys)))
    sliced = lambda df: df.withColumn("_key", _hashed(df, keys, facts)).join(hot, "_key", "left")
    left = sliced(facts).withColumn("_salt", _salt(keys, facts.columns)).drop("_key", "_slices")
    right = (
        sliced(lookup)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_key", "_slices")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def stored_bytes(table: DataFrame) -> int:
    """Planner's size of a stored table, which it takes from the files."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Join facts to a lookup table, by broadcast only if its counted size allows it.

    The lookup is written once, unless it already is a stored table, so that counting it and
    joining it read the same rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    table = lookup if stored else materialize(lookup)
    if stored_bytes(table) <= BROADCAST_BYTES and table.count() <= limit:
        return facts.join(F.broadcast(table), keys, how)
    return salted_join(facts, table, keys, how)
