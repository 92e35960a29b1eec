"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Token counts are summed per cell of the mixing columns. Raking scales the cells in turn until
the token shares of every column meet its targets, given ones or tempered shares. It ends when
no share is off by more than TOLERANCE of all tokens, after `rounds` sweeps at least. Targets
that no weights can meet together, such as those of two columns that always agree, or only in
many sweeps, end it after MOST_ROUNDS with a warning that says how far the shares are off; the
last column then meets its targets. A document is kept with the probability of its cell,
min(1, c * weight); c is chosen so that the expected tokens meet the budget. A hash of the
doc_id decides, so a re-run keeps the same documents.

A null in a mixing column is a value of its own, `(none)`. A row without doc_id is decided by
its text. Null and empty texts have no tokens: they do not count for the shares and get the
probability of their cell, or 1 where the cell holds no tokens. Repeated rows are kept or left
together. An empty table gives an empty table. Columns named like an output are replaced.
"""

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.llm.common import free_name, is_small, materialize, salted_join, text_column

ALPHA = 0.7
KEEP = 0.5
ROUNDS, MOST_ROUNDS = 12, 60
TOLERANCE = 1e-6
SEED = 17
NONE = "(none)"
OUTPUTS = ("n_tokens", "weight", "probability")


def form_topic(text: str = "text") -> Column:
    """A coarse topic by the form of a text: table, noisy, contact or prose."""
    body = text_column(text)
    return (
        F.when(body.contains(" | "), "table")
        .when(body.rlike("[#$%&*!]{2,}"), "noisy")
        .when(body.contains("@"), "contact")
        .otherwise("prose")
    )


def token_count(text: str = "text") -> Column:
    return F.regexp_count(text_column(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(cells: DataFrame, column: str, alpha: float) -> DataFrame:
    """value, share: token shares of the column raised to alpha, so that small values gain."""
    sums = cells.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    total = sums.agg(F.sum(F.pow("t", F.lit(alpha)))).first()[0] or 1.0
    return sums.select("value", (F.pow("t", F.lit(alpha)) / total).alias("share"))


def _ended(gap: float, done: int, rounds: int) -> bool:
    """Whether to stop after so many sweeps with shares off by the gap."""
    if done < rounds:
        return False
    if gap <= TOLERANCE:
        return True
    if done < max(rounds, MOST_ROUNDS):
        return False
    warnings.warn(f"shares are still off by {gap:.2g} after {done} rounds; the targets may not fit together", stacklevel=2)
    return True


def _rake_local(cells: pd.DataFrame, targets: dict[str, dict], rounds: int) -> np.ndarray:
    tokens = cells["tokens"].to_numpy(float)
    weight = np.ones(len(cells))
    total = tokens.sum()
    coded = {c: pd.factorize(cells[c]) for c in targets}
    gap, done = np.inf, 0
    while not _ended(gap, done, rounds):
        gap = 0.0
        for column, shares in targets.items():
            code, values = coded[column]
            mass = np.bincount(code, weight * tokens, len(values)).astype(float)
            wanted = np.array([shares.get(v, 0.0) for v in values]) * total
            weight = weight * np.divide(wanted, mass, out=np.zeros_like(mass), where=mass > 0)[code]
            gap = max(gap, np.abs(wanted - mass).max(initial=0.0) / max(total, 1.0))
        done += 1
    return weight


def _rake_wide(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """The same scaling as joins and sums, for more cells than one task should hold."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.lit(1.0))
    gap, done = float("inf"), 0
    while not _ended(gap, done, rounds):
        gap = 0.0
        for column, shares in targets.items():
            mass = now.groupBy(column).agg(F.sum(F.col("weight") * F.col("tokens")).alias("_mass"))
            wanted = F.coalesce("share", F.lit(0.0)) * total
            scale = mass.join(shares.withColumnRenamed("value", column), column, "left").select(
                column, F.when(F.col("_mass") > 0, wanted / F.col("_mass")).otherwise(0.0).alias("_scale"), F.abs(wanted - F.col("_mass")).alias("_gap")
            )
            scale = materialize(scale)
            gap = max(gap, (scale.agg(F.max("_gap")).first()[0] or 0.0) / max(total, 1))
            scale = scale.drop("_gap")
            joined = now.join(F.broadcast(scale), column) if is_small(scale) else salted_join(now, scale, [column])
            now = joined.withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale")
        now = materialize(now)
        done += 1
    return now


def _factor_local(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """c for which the sum of tokens * min(1, c * weight) is the budget."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order], weight[order]
    capped = np.concatenate([[0.0], np.cumsum(t)[:-1]])
    rest = np.cumsum((t * w)[::-1])[::-1]
    c = np.divide(budget - capped, rest, out=np.full(len(t), np.inf), where=rest > 0)
    # Cells without weight at the end have no factor: 0 times infinity fits nothing.
    with np.errstate(invalid="ignore"):
        fits = np.flatnonzero(c * w <= 1)
    return float(c[fits[0]]) if len(fits) else float("inf")


def _factor_wide(cells: DataFrame, budget: float) -> float:
    low, high = 0.0, 1.0
    used = lambda c: cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * c))).first()[0] or 0.0
    limit = cells.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0
    if budget >= limit:
        return float("inf")
    while used(high) < budget:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if used(middle) < budget else (low, middle)
    return high


def given(cells: DataFrame, column: str, weights: dict[str, float]) -> DataFrame:
    """value, share: the given weights as shares among the values that hold tokens."""
    if not all(0 <= w < float("inf") for w in weights.values()):
        raise ValueError(f"target weights must be finite and not negative: {weights}")
    wanted = cells.sparkSession.createDataFrame([(v, float(w)) for v, w in weights.items()], "value string, wanted double")
    held = cells.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    found = held.join(F.broadcast(wanted), "value", "left").select("value", F.coalesce("wanted", F.lit(0.0)).alias("wanted"))
    total = found.agg(F.sum("wanted")).first()[0]
    if total is not None and total <= 0:
        raise ValueError(f"no text of the input has a value with a target weight: {weights}")
    return found.select("value", (F.col("wanted") / (total or 1.0)).alias("share"))


def cell_probabilities(
    cells: DataFrame,
    columns: list[str],
    alpha: float,
    keep: float,
    rounds: int,
    local: bool | None = None,
    weights: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """Cells with weight and probability; cells(columns..., tokens) is a stored table."""
    weights = weights or {}
    targets = {c: given(cells, c, weights[c]) if c in weights else tempered(cells, c, alpha) for c in columns}
    if is_small(cells) if local is None else local:
        table = cells.orderBy(*columns).toPandas()
        shares = {c: {r["value"]: r["share"] for r in t.collect()} for c, t in targets.items()}
        tokens = table["tokens"].to_numpy(float)
        table["weight"] = _rake_local(table, shares, rounds)
        factor = _factor_local(tokens, table["weight"].to_numpy(), keep * tokens.sum())
        weight = table["weight"].to_numpy()
        some = np.minimum(1.0, np.multiply(weight, factor, out=np.zeros_like(weight), where=weight > 0))
        table["probability"] = np.where(tokens > 0, some, 1.0)
        schema = cells.schema.add("weight", "double").add("probability", "double")
        return cells.sparkSession.createDataFrame(table, schema)
    wide = _rake_wide(cells, targets, rounds)
    factor = _factor_wide(wide, keep * (cells.agg(F.sum("tokens")).first()[0] or 0))
    some = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * factor)).otherwise(0.0)
    return materialize(wide.withColumn("probability", F.when(F.col("tokens") > 0, some).otherwise(1.0)))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the id, the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), doc_id))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(
    docs: DataFrame,
    columns: dict[str, Column],
    doc_id: str = "doc_id",
    text: str = "text",
    alpha: float = ALPHA,
    keep: float = KEEP,
    rounds: int = ROUNDS,
    local: bool | None = None,
    targets: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """The sampled documents with n_tokens, weight and probability.

    columns maps names to the expressions to mix by. targets maps some of these names to the
    wished weights of their values (`(none)` for null); a value without a weight gets none, and
    the weights count in proportion to each other. The targets of other columns are their token
    shares raised to alpha. rounds is the least number of sweeps. About keep of all tokens stay.
    """
    unknown = set(targets or {}) - set(columns)
    if unknown:
        raise ValueError(f"targets for columns that are not mixed: {sorted(unknown)}")
    names = [free_name(docs.columns, f"_mix{i}") for i in range(len(columns))]
    weights = {n: targets[c] for n, c in zip(names, columns, strict=True) if targets and c in targets}
    made = {n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, columns.values(), strict=True)}
    source = docs.select(*(c for c in docs.columns if c not in OUTPUTS), *(e.alias(n) for n, e in made.items()), token_count(text).alias("n_tokens"))
    cells = materialize(source.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")))
    found = cell_probabilities(cells, names, alpha, keep, rounds, local, weights).drop("tokens")
    small = is_small(cells)
    joined = source.join(F.broadcast(found), names) if small else salted_join(source, found, names)
    key = F.coalesce(F.col(doc_id).cast("string"), text_column(text))
    return joined.where(draw(key) < F.col("probability")).select(*(c for c in source.columns if c not in names), "weight", "probability")
