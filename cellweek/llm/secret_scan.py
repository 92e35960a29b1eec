"""Secret scan: exact patterns, and a character convolutional network over other candidates.

One pass finds the base spans of every text and its candidates, that is long runs of key-like
characters, each with its context. Labels for training: a run that a base span touches is a
secret; a run that reads like words or numbers, with no letter beside a digit and long parts of
one kind, is none; all others stay unlabelled and are only scored. Two thirds of the distinct
findings of either label, of any length, train the network: they are dealt out to parts, the rarer
label to several, every part makes balanced steps through all that it has, and after every round
the networks of the parts are averaged. Contexts are hidden and keys shuffled now and then, so that
it also learns what a key looks like away from a keyword, and from few findings. Probabilities are
calibrated on the other third, which training did not see; the threshold keeps the wished recall
there, with their context and without it, and lets through no more of the others than the highest
such threshold would. A second pass over the stored candidates scores those that no base span
touches.

Null and empty texts have no spans. Without a finding of each label there is nothing to fit and
the base spans are the result; a single finding of a label serves for training and for the
threshold. Repeated rows are scanned each, rows without doc_id too. An empty table gives an empty
table. Extra columns are ignored. Positions are code points. Runs of any length are scored whole,
in pieces of bounded size.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweek.llm.common import materialize, text_column
from cellweek.operators.ranking import global_rank

# The base patterns.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "model"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, AFTER = 24, 8
RECALL = 0.98
# Rounds of the fit; the least number of steps of a part in a round; findings of a step.
ROUNDS, STEPS, STEP_ROWS = 5, 100, 64
# Up to so many findings of a label are one part, drawn at random for all the steps at once.
SMALL_ROWS = 3000
# Findings of a label and bytes of codes in a part.
PART_ROWS, PART_BYTES = 8000, 32 * 1024 * 1024
# Networks are averaged as whole multiples of this, so the sum does not depend on its order.
UNIT = 2.0**-32
# Calibration counts margins to this step.
MARGIN_STEP, MARGIN_MOST = 0.01, 35
FILTERS, WIDTH, SIZE = 24, 5, 8
# Characters of one network step: candidates times padded length.
STEP_CHARS = 100_000
# A run reads like words or numbers if its same-kind parts have this length on average.
PLAIN_PART = 4
_MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CODES = 97
# Codes of A-Z and a-z within a candidate.
_LETTERS = np.array([(ord(c) - 31) | 128 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"], np.uint8)

# Codes of a context that is hidden.
_HIDDEN = bytes(c if c >= 128 else 1 for c in range(256))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base findings by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def is_plain(run: str) -> bool:
    """Whether a run reads like words or numbers: no letter beside a digit, and long parts."""
    return not _MIXED.search(run) and sum(1 for _ in _PARTS.finditer(run)) * PLAIN_PART <= len(run)


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bool | None]]:
    """start, end and label of the candidates: secret, none, or unlabelled (None).

    spans are in order of their starts. Those that end before a candidate are passed for good,
    so one walk over both lists is enough.
    """
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        if at < len(spans) and spans[at][1] < b:
            found.append((a, b, True))
        else:
            found.append((a, b, False if is_plain(m[0]) else None))
    return found


def codes(text: str, start: int, end: int) -> bytes:
    """Codes of a candidate with its context; the high bit marks the candidate itself."""
    a = max(0, start - BEFORE)
    out = bytearray(min(ord(c) - 31, _CODES - 1) if ord(c) >= 32 else 1 for c in text[a : end + AFTER])
    for i in range(start - a, end - a):
        out[i] |= 128
    return bytes(out)


def gathered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, spans and candidates of every row, stored."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("known", pa.bool_()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                items.append([{"start": a, "end": b, "known": known, "codes": codes(t, a, b)} for a, b, known in candidates(t, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(item))], names=["doc_id", "spans", "items"])

    schema = (
        "doc_id long, spans array<struct<kind:string,start:long,end:long>>, "
        "items array<struct<start:long,end:long,known:boolean,codes:binary>>"
    )
    return materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text)).mapInArrow(run, schema))


# What the fit changes, and the shift.
LEARNED = ("embed", "filters", "bias", "out")


@dataclass
class Network:
    """Embedding, one convolution with the largest response of each filter, and a linear output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int = 5) -> "Network":
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.3, (_CODES, SIZE))
        embed[0] = 0
        return cls(embed, rng.normal(0, 0.2, (WIDTH * (SIZE + 1), FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), 0.0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each row of codes, 0 at least, and the codes it is from."""
        data = self.features(x)
        windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH, axis=1).transpose(0, 1, 3, 2)
        response = windows.reshape(len(x), -1, WIDTH * (SIZE + 1)) @ self.filters + self.bias
        best = response.argmax(axis=1)
        top = np.maximum(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :], 0)
        return top, x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(WIDTH)]

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.embed[x & 127], (x >= 128)[..., None].astype(float)], axis=-1)

    def pooled(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """forward() of encoded candidates, in groups of like length; long ones go in pieces."""
        order = sorted((i for i in range(len(rows)) if len(rows[i]) <= STEP_CHARS), key=lambda i: len(rows[i]))
        top, seen = np.empty((len(rows), FILTERS)), np.empty((len(rows), FILTERS, WIDTH), np.uint8)
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * len(rows[order[end]]) <= STEP_CHARS:
                end += 1
            part = order[start:end]
            top[part], seen[part] = self.forward(padded([rows[i] for i in part]))
            start = end
        for i, row in enumerate(rows):
            if len(row) > STEP_CHARS:
                # Pieces overlap by a window less one, so the largest response is that of the whole.
                top[i] = -1
                for e in range(STEP_CHARS, len(row) + STEP_CHARS - WIDTH + 1, STEP_CHARS - WIDTH + 1):
                    there, codes_ = self.forward(padded([row[e - STEP_CHARS : e]]))
                    more = there[0] > top[i]
                    top[i][more], seen[i][more] = there[0][more], codes_[0][more]
        return top, seen

    def margins(self, rows: list[bytes]) -> np.ndarray:
        return self.pooled(rows)[0] @ self.out + self.shift

    def vector(self) -> np.ndarray:
        return np.concatenate([*(getattr(self, n).ravel() for n in LEARNED), [self.shift]])

    @classmethod
    def of(cls, vector: np.ndarray) -> "Network":
        net, at = cls.new(), 0
        for n in LEARNED:
            old = getattr(net, n)
            setattr(net, n, vector[at : at + old.size].reshape(old.shape).copy())
            at += old.size
        net.shift = float(vector[at])
        return net

    def probabilities(self, rows: list[bytes]) -> np.ndarray:
        return self.calibrated(self.margins(rows))

    def calibrated(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -35, 35)))


def padded(rows: list[bytes]) -> np.ndarray:
    width = max(WIDTH, max(len(r) for r in rows))
    return np.stack([np.frombuffer(r.ljust(width, b"\0"), np.uint8) for r in rows])


def without_context(row: bytes) -> bytes:
    return row.translate(_HIDDEN)


def redrawn(row: bytes, rng: np.random.Generator) -> bytes:
    """The row with the characters of its candidate in another order, at times with other letters."""
    data = np.frombuffer(row, np.uint8).copy()
    inside = np.flatnonzero(data & 128)
    data[inside] = data[rng.permutation(inside)]
    if rng.random() < 0.5:
        letters = inside[np.isin(data[inside], _LETTERS)]
        data[letters] = rng.choice(_LETTERS, len(letters))
    return data.tobytes()


def recall_threshold(positive: np.ndarray, negative: np.ndarray, recall: float = RECALL) -> float:
    """A margin that finds at least the wished share of the positives.

    The highest such margin is lowered half-way to the next negative below it: that lets no
    further negative through, and leaves room for secrets unlike those known.
    """
    highest = np.sort(positive)[_missed(len(positive), recall)]
    below = negative[negative < highest]
    return float((highest + below.max()) / 2 if len(below) else highest)


def _missed(n: int, recall: float = RECALL) -> int:
    """How many of n positives may lie below the threshold."""
    return int(np.floor((1 - recall) * n))


def split_findings(labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Positions to learn from and to check with: two thirds and a third of each label."""
    learn, check = [], []
    for label in (1, 0):
        at = rng.permutation(np.flatnonzero(labels == label))
        kept = max(1, len(at) // 3)
        check.append(at[:kept])
        learn.append(at[kept:] if len(at) > 1 else at)
    return np.concatenate(learn), np.concatenate(check)


def descend(vector: np.ndarray, sides: list[list[bytes]], rng: np.random.Generator, draws: int = 0) -> np.ndarray:
    """Network and AdaGrad sums after balanced steps through the findings: secrets, then others.

    Every finding is taken at least once, those of the rarer label and of short lists again; or,
    given a number of steps, findings are drawn anew for each.
    """
    net, sums = Network.of(vector), Network.of(vector[len(vector) // 2 :])
    half = STEP_ROWS // 2
    steps = draws or max(STEPS, *(-(-len(rows) // half) for rows in sides))
    if not draws:
        orders = [np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps * half // len(rows)))]) for rows in sides]
    truth = np.repeat([1.0, 0.0], half)
    for step in range(steps):
        taken = [rng.choice(len(rows), half) for rows in sides] if draws else [order[step * half : (step + 1) * half] for order in orders]
        part = [rows[i] for rows, at in zip(sides, taken, strict=True) for i in at]
        shown = [without_context(r) if rng.random() < 0.5 else r for r in part]
        top, seen = net.pooled([redrawn(r, rng) if t and rng.random() < 0.5 else r for r, t in zip(shown, truth, strict=True)])
        margin = top @ net.out + net.shift
        error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - truth) / len(part)
        back = error[:, None] * net.out * (top > 0)
        grads = {
            "out": top.T @ error,
            "bias": back.sum(axis=0),
            "filters": np.einsum("nf,nfw->wf", back, net.features(seen).reshape(len(part), FILTERS, -1)),
            "embed": np.zeros_like(net.embed),
        }
        to_input = (back[:, :, None] * net.filters.T[None]).reshape(len(part), FILTERS, WIDTH, SIZE + 1)[..., :SIZE]
        np.add.at(grads["embed"], seen & 127, to_input)
        grads["embed"][0] = 0
        for name, g in grads.items():
            setattr(sums, name, getattr(sums, name) + g * g)
            setattr(net, name, getattr(net, name) - 0.08 * g / np.sqrt(getattr(sums, name)))
        net.shift -= 0.1 * error.sum()
    return np.concatenate([net.vector(), sums.vector()])


def _start(seed: int = 5) -> np.ndarray:
    vector = Network.new(seed).vector()
    return np.concatenate([vector, np.full_like(vector, 1e-4)])


def calibrate(net: Network, margins: np.ndarray, truth: np.ndarray, counts: np.ndarray) -> None:
    """Slope and offset by which margins, so many of each, become probabilities."""
    share = counts / counts.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(net.slope * margins + net.offset, -35, 35)))
        net.slope = max(0.05, net.slope - 0.5 * float(((p - truth) * margins) @ share))
        net.offset -= 0.5 * float((p - truth) @ share)


def fit_network(rows: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """The fit on few findings: two thirds of each label to learn from, the rest to check with."""
    rng = np.random.default_rng(seed)
    learn, check = split_findings(labels, rng)
    net = Network.of(descend(_start(seed), [[rows[i] for i in learn if labels[i] == side] for side in (1, 0)], rng, ROUNDS * STEPS))
    margins = [net.margins(part) for part in ([rows[i] for i in check], [without_context(rows[i]) for i in check])]
    secret = labels[check] == 1
    calibrate(net, np.concatenate(margins), np.tile(labels[check], 2), np.ones(2 * len(check)))
    net.threshold = float(net.calibrated(np.array([min(recall_threshold(m[secret], m[~secret]) for m in margins)]))[0])
    return net


def findings(stored: DataFrame) -> tuple[DataFrame, dict[bool, int], int]:
    """The distinct findings, stored, with their position among those of their label; counts; bytes.

    Positions follow a hash of the codes, so they depend on nothing but the findings.
    """
    found = stored.select(F.explode("items").alias("i")).select("i.known", "i.codes").where("known is not null").distinct()
    ranked = materialize(global_rank(found.withColumn("hash", F.xxhash64("codes")), ["known", "hash", "codes"], "place").drop("hash"))
    sums = ranked.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("codes")).alias("b")).collect()
    counts = {r["known"]: r["n"] for r in sums}
    place = F.col("place") - F.when(F.col("known"), counts.get(False, 0)).otherwise(0)
    return ranked.withColumn("place", place), counts, sum(r["b"] for r in sums)


def _parts(found: DataFrame, counts: dict[bool, int], size: int) -> tuple[DataFrame, int]:
    """part, known, place and codes of the findings to learn from, and the number of parts.

    The findings of the rarer label go to as many parts as make up for that, all at most, so
    every part has findings of both.
    """
    learned = {known: n - -(-n // 3) if n > 1 else 1 for known, n in counts.items()}
    most = max(learned.values())
    parts = min(most, max(-(-most // PART_ROWS), -(-size // PART_BYTES)))
    copies = {known: min(parts, -(-most // n)) for known, n in learned.items()}
    number = lambda of: F.when(F.col("known"), F.lit(of[True])).otherwise(F.lit(of[False]))
    alone = number(counts) == 1
    index = F.when(alone, F.lit(0)).otherwise(F.floor(F.col("place") / 3) * 2 + F.col("place") % 3 - 1)
    first = index * number(copies)
    dealt = F.explode(F.transform(F.sequence(first, first + number(copies) - 1), lambda i: i % parts))
    return found.where(alone | (F.col("place") % 3 != 0)).select(dealt.alias("part"), "known", "place", "codes"), parts


def _round(dealt: DataFrame, parts: int, vector: np.ndarray, number: int) -> np.ndarray:
    """The mean of what every part makes of the network."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        sides = [[bytes(c) for c in pdf["codes"][pdf["known"] == side]] for side in (True, False)]
        made = descend(vector, sides, np.random.default_rng([number, int(pdf["part"].iloc[0])]))
        return pd.DataFrame({"at": np.arange(len(made)), "units": np.round(made / UNIT).astype(np.int64)})

    made = dealt.repartition(parts, "part").groupBy("part").applyInPandas(run, "at int, units long")
    sums = {r["at"]: r["units"] for r in made.groupBy("at").agg(F.sum("units").alias("units")).collect()}
    return np.array([sums[i] * UNIT / parts for i in range(len(vector))])


def _check_margins(found: DataFrame, net: Network) -> DataFrame:
    """known, place, hidden and margin of the held-out findings, with their context and without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            for hidden in (False, True):
                margins = net.margins([without_context(r) for r in rows] if hidden else rows)
                columns = [batch.column(0), batch.column(1), pa.array([hidden] * len(rows)), pa.array(margins)]
                yield pa.RecordBatch.from_arrays(columns, names=["known", "place", "hidden", "margin"])

    held = found.where(F.col("place") % 3 == 0).select("known", "place", "codes")
    return materialize(held.mapInArrow(run, "known boolean, place long, hidden boolean, margin double"))


def _lowest_margin(checked: DataFrame) -> float:
    """The lower recall_threshold() of the held-out findings with their context and without."""
    secrets = checked.where("known").select("hidden", "margin", "place")
    n = secrets.where("not hidden").count()
    at = [_missed(n), n + _missed(n)]
    ranked = global_rank(secrets, ["hidden", "margin", "place"])
    highest = {r["hidden"]: r["margin"] for r in ranked.where(F.col("rank").isin(at)).collect()}
    limit = F.when(F.col("hidden"), highest[True]).otherwise(highest[False])
    below = checked.where(~F.col("known") & (F.col("margin") < limit)).groupBy("hidden").agg(F.max("margin").alias("m"))
    lower = {r["hidden"]: r["m"] for r in below.collect()}
    return min((m + lower.get(hidden, m)) / 2 for hidden, m in highest.items())


def train(stored: DataFrame) -> Network | None:
    """Fit, calibration and threshold on all distinct findings; none if a label has no finding."""
    found, counts, size = findings(stored)
    if len(counts) < 2:
        return None
    if max(counts.values()) <= SMALL_ROWS and size <= PART_BYTES:
        rows = found.orderBy(F.desc("known"), "place").select("known", "codes").collect()
        return fit_network([bytes(r["codes"]) for r in rows], np.array([float(r["known"]) for r in rows]))
    dealt, parts = _parts(found, counts, size)
    vector = _start()
    for number in range(ROUNDS):
        vector = _round(dealt, parts, vector, number)
    net = Network.of(vector)
    checked = _check_margins(found, net)
    step = F.round(F.greatest(F.least("margin", F.lit(MARGIN_MOST)), F.lit(-MARGIN_MOST)) / MARGIN_STEP).cast("int")
    bins = checked.groupBy("known", step.alias("step")).count().orderBy("known", "step").toPandas()
    calibrate(net, bins["step"].to_numpy() * MARGIN_STEP, bins["known"].to_numpy(float), bins["count"].to_numpy(float))
    net.threshold = float(net.calibrated(np.array([_lowest_margin(checked)]))[0])
    return net


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, probability), by start and kind, of every row."""
    stored = gathered(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(train(stored))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            bases, items = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            open_ = [(n, i) for n, row in enumerate(items) for i in row if i["known"] is not True] if network else []
            sure = network.probabilities([i["codes"] for _, i in open_]) if open_ else []
            out = [[{**s, "probability": 1.0} for s in row] for row in bases]
            for (n, i), p in zip(open_, sure, strict=True):
                if p >= network.threshold:
                    out[n].append({"kind": "model", "start": i["start"], "end": i["end"], "probability": float(p)})
            for row in out:
                row.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return stored.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,probability:double>>")


__all__ = ["base_spans", "candidates", "codes", "fit_network", "gathered", "scan", "train"]
