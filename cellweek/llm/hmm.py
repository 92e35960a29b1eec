"""Hidden Markov language model over word classes, trained by Baum-Welch.

A token's class is a hash of the word; the end of a text has its own class. The model gives
P(word | state) = P(class | state) * P(word | class); the second factor comes from smoothed
counts of the whole training corpus, with room for one unknown word per class. So the model is
of fixed size, and the word counts, which grow with the corpus, stay in a table.

Counting: every partition counts its training words, sums meet per word. Words above a count are
few by choice of that count and are broadcast; the occurrences of others are joined. Training:
each round, partitions add up expected counts of states by the scaled forward-backward recursion
over whole texts; a sum over partitions gives the next parameters. Start values come from some
rounds on a bounded sample. Scoring: the scaled forward recursion gives the exact likelihood.

Rows whose crc32 of the doc_id text, modulo 10, is 0 are held out from training; so are rows
without a doc_id. A null or empty text is the end token alone. Repeated rows count again.
Without training rows every class is equally likely. An empty table gives an empty table.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.llm.common import materialize, text_column, utf8

CLASSES = 4096
STATES = 6
ROUNDS = 3
START_ROUNDS = 10
START_TEXTS = 400
# Words that are broadcast with their counts, at most.
FREQUENT = 150_000
GATHERED = 300_000
ADD = 0.1
# No word holds white space; a word could share this hash by chance only (one in 2^64).
END = xxhash.xxh64_intdigest(b"\n") - (1 << 63)
# Tokens whose state probabilities are in memory at once.
STEP_TOKENS = 300_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """key, c: occurrences of every token of the training rows, in a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0

        def flush(more: list[tuple[int, int]]) -> pa.RecordBatch:
            keys = [word_key(w) for w in counts] + [k for k, _ in more]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*counts.values(), *(n for _, n in more)], pa.int64())], names=["key", "n"])

        for batch in batches:
            for raw in utf8(batch.column(0)):
                counts.update(raw.lower().split())
                ends += 1
                if len(counts) >= GATHERED:
                    yield flush([])
                    counts.clear()
        yield flush([(END, ends)] if ends else [])

    train = docs.where(~F.col("held_out")).select(text_column(text).alias("t"))
    return materialize(train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")))


def word_class(key: Column) -> Column:
    return F.when(key == END, CLASSES).otherwise(F.pmod(key, F.lit(CLASSES))).cast("int")


def frequent_words(vocabulary: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and counts of at most `most` frequent words, and the least count among them."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    total, least = 0, None
    for row in levels.orderBy(F.desc("level")).collect():
        total += row["n"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 62
    table = vocabulary.where(F.col("c") >= least).toPandas().sort_values("key")
    return table["key"].to_numpy(np.int64), table["c"].to_numpy(np.int64), int(least)


def encode(docs: DataFrame, text: str, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """row, doc_id, held_out, n_tokens, classes, known_log, n_known, rare: one stored row per document.

    known_log sums the log10 of the smoothed counts of frequent words; rare has the keys of the
    other tokens. row numbers the rows of the stored table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))
    names = ["row", "doc_id", "held_out", "n_tokens", "classes", "known_log", "n_known", "rare"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_keys, known_counts = shared.value
        logs = np.log10(known_counts + ADD)
        row = TaskContext.get().partitionId() << 40
        seen: dict[bytes, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for raw in utf8(batch.column(2)):
                words = raw.lower().split()
                if len(seen) > GATHERED:
                    seen.clear()
                for w in set(words):
                    if w not in seen:
                        seen[w] = word_key(w)
                h = np.fromiter((seen[w] for w in words), dtype=np.int64, count=len(words))
                h = np.append(h, END)
                at = np.searchsorted(known_keys, h)
                at[at == len(known_keys)] = 0
                found = known_keys[at] == h if len(known_keys) else np.zeros(len(h), bool)
                classes = (h % CLASSES).astype(np.int16)
                classes[-1] = CLASSES
                row += 1
                for column, value in zip(out, (row, len(h), classes.tobytes(), float(logs[at[found]].sum()) if found.any() else 0.0, int(found.sum()), h[~found]), strict=True):
                    column.append(value)
            rows = [pa.array(out[0], kinds[0]), batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out[1:], kinds[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(rows, names=names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, classes binary, known_log double, n_known long, rare array<long>"
    return materialize(docs.select(F.col("doc_id").cast("long"), "held_out", text_column(text)).mapInArrow(run, schema))


@dataclass
class Model:
    """Start, transition and class probabilities; class_ is (CLASSES + 1, states)."""

    start: np.ndarray
    move: np.ndarray
    class_: np.ndarray


def first_model(share: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    class_ = share[:, None] * np.exp(rng.normal(0, 1, (len(share), states)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, class_ / class_.sum(axis=0))


class Packed:
    """Sequences in order of time: at every step the rows still running come first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in self.order])
        flat = np.concatenate([sequences[i] for i in self.order]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        time = np.arange(len(flat)) - np.repeat(starts, lengths)
        by_time = np.argsort(time, kind="stable")
        self.classes = flat[by_time]
        self.owner = np.repeat(np.arange(len(lengths)), lengths)[by_time]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(time))])

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state probabilities and scales of every token."""
        emit = model.class_[self.classes]
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        for t in range(len(self.edges) - 1):
            a, b = self.edges[t], self.edges[t + 1]
            if t:
                before = self.edges[t - 1]
                now = (alpha[before : before + b - a] @ model.move) * emit[a:b]
            else:
                now = model.start * emit[a:b]
            total = now.sum(axis=1)
            scale[a:b] = total
            alpha[a:b] = now / total[:, None]
        return alpha, scale

    def log_likelihoods(self, model: Model) -> np.ndarray:
        """log10 likelihood of every sequence, in the order given."""
        _, scale = self.forward(model)
        sums = np.bincount(self.owner, np.log10(scale), len(self.order))
        out = np.empty(len(self.order))
        out[self.order] = sums
        return out

    def expected(self, model: Model) -> np.ndarray:
        """Expected counts of starts, moves and classes by state, in one vector."""
        alpha, scale = self.forward(model)
        emit = model.class_[self.classes]
        states = alpha.shape[1]
        moves = np.zeros((states, states))
        gamma = np.empty_like(alpha)
        beta = np.ones((0, states))
        for t in range(len(self.edges) - 2, -1, -1):
            a, b = self.edges[t], self.edges[t + 1]
            now = np.ones((b - a, states))
            n = len(beta)
            if n:
                ahead = emit[b : b + n] * beta / scale[b : b + n, None]
                moves += alpha[a : a + n].T @ ahead
                now[:n] = ahead @ model.move.T
            gamma[a:b] = alpha[a:b] * now
            beta = now
        width = len(model.class_)
        classes = np.stack([np.bincount(self.classes, gamma[:, s], width) for s in range(states)], axis=1)
        return np.concatenate([gamma[: self.edges[1]].sum(axis=0), (moves * model.move).ravel(), classes.ravel()])


def packs(raw: list[bytes]) -> Iterator[tuple[list[int], Packed]]:
    """Groups of sequences of like length, with their positions in the input."""
    sequences = [np.frombuffer(x, np.int16) for x in raw]
    order = sorted(range(len(raw)), key=lambda i: len(sequences[i]))
    group: list[int] = []
    total = 0
    for i in order:
        if group and total + len(sequences[i]) > STEP_TOKENS:
            yield group, Packed([sequences[j] for j in group])
            group, total = [], 0
        group.append(i)
        total += len(sequences[i])
    if group:
        yield group, Packed([sequences[j] for j in group])


def updated(counts: np.ndarray, share: np.ndarray, states: int) -> Model:
    """Parameters from expected counts; classes are smoothed by their share of all tokens."""
    start = counts[:states] + 1
    move = counts[states : states + states * states].reshape(states, states) + 1
    class_ = counts[states + states * states :].reshape(-1, states) + 100 * share[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), class_ / class_.sum(axis=0))


def train(encoded: DataFrame, share: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    """Baum-Welch over all training rows of the encoded table."""
    spark = encoded.sparkSession
    model = first_model(share, states)
    rows = encoded.where("NOT held_out").select("doc_id", "classes")
    # About START_TEXTS rows by a hash of their content, so neither the file layout nor the number
    # of tasks changes the choice. Equal rows share a hash; one of each is taken.
    share_of = min(1.0, START_TEXTS / max(1, rows.count()))
    mark = F.xxhash64("doc_id", "classes")
    chosen = rows.where(F.pmod(mark, F.lit(1 << 30)) < int(share_of * (1 << 30))).dropDuplicates()
    sample = [bytes(r["classes"]) for r in chosen.orderBy(mark, "doc_id", "classes").collect()]
    if not sample:
        return model
    for _ in range(START_ROUNDS):
        model = updated(sum(p.expected(model) for _, p in packs(sample)), share, states)
    size = states + states * states + len(share) * states
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for _, pack in packs(batch.column(0).to_pylist()):
                    total += pack.expected(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

        sums = rows.select("classes").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        counts = np.zeros(size)
        counts[[r["i"] for r in sums]] = [r["v"] for r in sums]
        model = updated(counts, share, states)
        shared.unpersist()
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, states: int = STATES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    vocabulary = count_words(source, "text")
    classes = np.zeros(CLASSES + 1)
    types = np.zeros(CLASSES + 1)
    for r in vocabulary.groupBy(word_class(F.col("key")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        classes[r["k"]], types[r["k"]] = r["c"], r["v"]
    n, v = int(classes.sum()), int(types.sum())
    room = classes + ADD * (types + 1)
    keys, counts, least = frequent_words(vocabulary, frequent)
    encoded = encode(source, "text", keys, counts)
    model = train(encoded, room / room.sum(), rounds, states)

    seldom = vocabulary.where(F.col("c") < least)
    parts = encoded.select("row", F.explode("rare").alias("key")).join(seldom, "key", "left")
    rare = parts.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("_log"), F.count("c").alias("_known")
    )
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(room)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, rooms = shared.value
        for batch in batches:
            raw = batch.column("classes").to_pylist()
            out = np.zeros(len(raw))
            for at, pack in packs(raw):
                out[at] = pack.log_likelihoods(fitted) - [rooms[np.frombuffer(raw[i], np.int16)].sum() for i in at]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=[*names, "_model"])

    names = ["row", "doc_id", "held_out", "n_tokens", "known_log", "n_known"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known_log double, n_known long, _model double"
    scored = encoded.select(*names, "classes").mapInArrow(run, schema).join(rare, "row", "left")
    words = F.col("known_log") + F.coalesce("_log", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * float(np.log10(n + ADD * (v + 1)))).alias("base_score"),
        (words + F.col("_model")).alias("score"),
    )
