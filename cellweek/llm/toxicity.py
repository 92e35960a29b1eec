"""Toxicity score by a factorization machine over hashed terms.

Terms of a text are its distinct words and the first four and five letters of longer words,
lower-cased and hashed. A bounded sample of labelled texts is used to fit the model: terms that
go with either class are selected by their document counts, then linear weights and factors are
fitted by AdaGrad. The factors give a weight to pairs of terms, for example an insult together
with a group mention. All texts are scored.

A null or empty text has no terms and gets the score of the bias. Labels that are null are left
out; with several labels for a doc_id the highest counts. Copies of a text are one example. Without labels of both
classes every score is the share of toxic labels (0 without labels). Repeated rows and ties get
equal scores; an empty table gives an empty table. Columns named like an output are replaced.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweek.llm.common import add_columns, materialize, slices, text_bytes, text_column, utf8

HASH_BITS = 20
# Bounds of the fit: labelled texts, selected terms, and selected terms used of one text.
MAX_TRAIN = 20_000
MAX_TERMS = 8192
MIN_TEXTS = 3
MIN_Z = 3.0
FACTORS = 4
EPOCHS, LEAST_STEPS, BATCH = 12, 1000, 64
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 200_000


class Terms:
    """Hashed terms of texts; remembers those of words it has seen."""

    def __init__(self, places: dict[int, int] | None = None):
        self.places = places
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        parts = ["w" + word] + ["p" + word[:n] for n in (4, 5) if len(word) > n]
        found = tuple(xxhash.xxh32_intdigest(p) & ((1 << HASH_BITS) - 1) for p in parts)
        if self.places is not None:
            found = tuple(self.places[x] for x in found if x in self.places)
        if len(self.known) >= _CACHED:
            self.known.clear()
        self.known[word] = found
        return found

    def of_text(self, raw: bytes) -> set[int]:
        known, found = self.known, set()
        for word in set(_WORD.findall(raw.decode().lower())):
            x = known.get(word)
            if x is None:
                x = self.of_word(word)
            if x:
                found.update(x)
        return found


@dataclass
class Machine:
    """A fitted model: places of the selected terms, bias, linear weights and factors."""

    places: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[set[int]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        margin = np.full(len(rows), self.bias)
        if sizes.sum():
            at = np.fromiter((x for r in rows for x in sorted(r)), dtype=np.int64, count=int(sizes.sum()))
            row = np.repeat(np.arange(len(rows)), sizes)
            margin += np.bincount(row, self.weights[at], len(rows))
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                margin += 0.5 * (np.bincount(row, v, len(rows)) ** 2 - np.bincount(row, v * v, len(rows)))
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit_machine(rows: list[list[int]], labels: np.ndarray, places: dict[int, int], seed: int = 7) -> Machine:
    """AdaGrad over mini-batches of term lists; weights and factors are shrunk towards zero."""
    rng = np.random.default_rng(seed)
    n = len(places)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    bias, weights = np.log(share / (1 - share)), np.zeros(n + 1)
    factors = rng.normal(0, 0.02, (n + 1, FACTORS))
    weights[n], factors[n] = 0, 0
    sum_b, sum_w, sum_v = 1e-6, np.full(n + 1, 1e-6), np.full((n + 1, FACTORS), 1e-6)
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // max(BATCH, len(rows)))
    for _ in range(epochs if n else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            width = max(1, max(len(rows[i]) for i in batch))
            at = np.full((len(batch), width), n)
            for k, i in enumerate(batch):
                at[k, : len(rows[i])] = rows[i]
            v = factors[at]
            total = v.sum(axis=1)
            margin = bias + weights[at].sum(axis=1) + 0.5 * (total**2 - (v**2).sum(axis=1)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[batch]) / len(batch)
            used, back = np.unique(at, return_inverse=True)
            back = back.reshape(at.shape)
            grad_w = np.bincount(back.ravel(), np.repeat(error, width), len(used)) + 1e-5 * weights[used]
            pull = error[:, None, None] * (total[:, None, :] - v)
            grad_v = np.stack([np.bincount(back.ravel(), pull[:, :, f].ravel(), len(used)) for f in range(FACTORS)], axis=1)
            grad_v += 1e-4 * factors[used]
            sum_b += error.sum() ** 2
            sum_w[used] += grad_w**2
            sum_v[used] += grad_v**2
            bias -= 0.1 * error.sum() / np.sqrt(sum_b)
            weights[used] -= 0.1 * grad_w / np.sqrt(sum_w[used])
            factors[used] -= 0.02 * grad_v / np.sqrt(sum_v[used])
            weights[n], factors[n] = 0, 0
    return Machine(places, float(bias), weights[:n], factors[:n])


def learns(doc_id: Column, parts: int = 4, held: int = 2) -> Column:
    """Whether a row may be learned from: crc32 of its id as text (null: empty), modulo parts, is not held.

    A row without id has no label, so it is learned from in name only; it is not held out.
    """
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts != held


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_TRAIN) -> Machine:
    """Fit on the texts of docs whose labels are in labels(doc_id, toxic), at most about `limit` of them.

    Beyond the limit, a hash of the doc_id chooses an even share of the labelled rows.
    """
    truth = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    )
    total = truth.count()
    chosen = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, limit / max(1, total))))
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    source = docs.select(F.col(doc_id).alias("_id"), text_column(text).alias("_t"))
    rows = source.join(F.broadcast(chosen) if total <= 50 * limit else chosen, "_id").select("_t", "_y")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Terms()
        for batch in batches:
            for a, b in slices(text_bytes(batch.column(0))):
                texts = utf8(batch.column(0).slice(a, b - a))
                digests = [xxhash.xxh64_intdigest(x) >> 1 for x in texts]
                lists = [sorted(hashed.of_text(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), batch.column(1).slice(a, b - a), pa.array(lists, pa.list_(pa.int32()))], names=["h", "y", "terms"])

    sample = materialize(rows.mapInArrow(terms, "h long, y int, terms array<int>"))
    examples = materialize(sample.groupBy("h", "terms").agg(F.max("y").alias("y")))
    size, positive = examples.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not size or not positive or positive == size:
        share = (positive or 0) / size if size else 0.0
        margin = np.log(share / (1 - share)) if 0 < share < 1 else (35.0 if share else -35.0)
        return Machine({}, float(margin), np.zeros(0), np.zeros((0, FACTORS)))
    base = positive / size
    counts = examples.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    z = (F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    chosen_terms = (
        counts.where(F.col("n") >= MIN_TEXTS)
        .withColumn("z", F.abs(z))
        .where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "term")
        .limit(MAX_TERMS)
        .select("term")
    )
    places = {r["term"]: i for i, r in enumerate(chosen_terms.collect())}
    wanted = F.array(*[F.lit(t) for t in ()]).cast("array<int>") if not places else F.lit(list(places))
    fitted = examples.select("h", "y", F.array_intersect("terms", wanted).alias("terms")).orderBy("h", "terms").collect()
    lists = [[places[x] for x in r["terms"]] for r in fitted]
    return fit_machine(lists, np.array([r["y"] for r in fitted], dtype=float), places)


def score_texts(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    cache: list[Terms] = []

    def make(texts: list[bytes]) -> list[list]:
        if not cache:
            cache.append(Terms(shared.value.places))
        scores = shared.value.scores([cache[0].of_text(x) for x in texts])
        return [scores.tolist(), (scores >= threshold).astype(int).tolist()]

    fields = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]
    return add_columns(docs, text, fields, make, docs.columns if keep is None else keep)
