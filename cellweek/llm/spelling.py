"""Spelling variant grouping: Bloom-guided neighbourhoods of the vocabulary.

The vocabulary holds the words with enough occurrences; each task counts its own words first.
Blocked Bloom filters of the vocabulary, one shard per word length, go to all tasks. Every word
generates its edits as hashes only: the hash of a word is a sum over its places, so deleting or
replacing a letter changes one prefix, suffix or summand. Edits that a filter admits are spelled
out and shuffled to an exact join with the vocabulary, which removes the false positives. Nearness
is symmetric, so a word generates only its deletions and the replacements by greater letters, and
each found pair counts for both of its words. Chains of forms are followed by pointer doubling:
counts at least double from a word to its form, so a chain is shorter than 63 links.

The filters are bounded: one pass takes at most ROUND_BYTES of them; a larger vocabulary is
probed in several passes, each with other ranges of filter blocks. No edit is left out.

Defined cases. Null or empty texts have no words. A null id counts as the empty text. Repeated
rows count every time. Letters are those of Latin-1, so a word is one byte per code point. Words
of any length are handled; all of LONG letters and more share one shard. Ties between forms go to
the word first in code-point order. A table without frequent words gives no rows. Other columns
are not read.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweek.llm.common import bounded_groups, materialize, utf8
from cellweek.operators.skew import lookup_join

MIN_LETTERS = 5
MIN_COUNT = 3
MODULUS = 97
# The letters of a run, and the folding of A-Z.
_LATIN = [c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0xC0]
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _LATIN else 0x20 for c in range(256))
# Distinct words that one task counts before it hands them on.
MOST_WORDS = 400_000
# Words of this many letters or more share a filter.
LONG = 64
BITS_PER_WORD = 24
BLOCK_BYTES, LEAST_BLOCKS = 32, 16
# Filter blocks built by one group, and bytes of filter that one pass takes.
CHUNK_BLOCKS = 4096
ROUND_BYTES = 32 * 1024 * 1024
# Edits that one step of a task hashes.
STEP_EDITS = 1 << 20
# The odd multipliers of the mixing function.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def runs(text: bytes) -> list[bytes]:
    """Letter runs of a UTF-8 text with A-Z folded, as Latin-1 bytes."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_FOLD).split()


def written(start: int, run: bytes, modulus: int) -> bytes:
    """The run, or the run without one letter where its checksum asks for that.

    start is the checksum of the text before the run.
    """
    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if code % modulus:
        return run
    place = code % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, key: str, text: str, least_letters: int, least: int, modulus: int) -> DataFrame:
    """word, n: the words with enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, body in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
                start = zlib.crc32(name + b":")
                for letters, n in Counter(runs(body)).items():
                    word = written(start, letters, modulus)
                    if len(word) >= least_letters:
                        counts[word] += n
                if len(counts) > MOST_WORDS:
                    yield batch_of()
                    counts.clear()
        if counts:
            yield batch_of()

    found = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    partial = found.mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def place_values(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Summand of each letter code at each place: a mixed 64-bit value."""
    x = (places.astype(np.uint64) * np.uint64(256) + codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


# Unrelated odd multipliers, one for each 32-bit lane of a filter block.
_LANES = place_values(np.arange(8), np.zeros(8)) & np.uint64(0xFFFFFFFF) | np.uint64(1)


def letters_of(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of letter codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Length and places of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(sizes[order[a]]), order[a:b]


def shard_of(length: int) -> int:
    return min(length, LONG)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def lane_bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The bit that each hash sets in one 32-bit lane of its block."""
    low = (hashes & np.uint64(0xFFFFFFFF)) * _LANES[lane] & np.uint64(0xFFFFFFFF)
    return np.uint32(1) << (low >> np.uint64(27)).astype(np.uint32)


def filter_sizes(vocabulary: DataFrame) -> dict[int, int]:
    """Number of blocks of each shard; at most LONG entries."""
    shard = F.least(F.length("word"), F.lit(LONG))
    rows = vocabulary.groupBy(shard.alias("shard")).count().collect()
    return {r["shard"]: max(LEAST_BLOCKS, -(-r["count"] * BITS_PER_WORD // (8 * BLOCK_BYTES))) for r in rows}


def filter_ranges(sizes: dict[int, int], most: int = ROUND_BYTES) -> list[list[tuple[int, int, int]]]:
    """Passes, each a list of (shard, first chunk, end chunk) that together fit into `most` bytes."""
    pieces = [(shard, c, c + 1) for shard, blocks in sorted(sizes.items()) for c in range(-(-blocks // CHUNK_BLOCKS))]
    width = lambda p: BLOCK_BYTES * (min(sizes[p[0]], p[2] * CHUNK_BLOCKS) - p[1] * CHUNK_BLOCKS)
    rounds = []
    for group in bounded_groups(pieces, width, most):
        spans: dict[int, tuple[int, int, int]] = {}
        for shard, a, b in group:
            spans[shard] = (shard, spans[shard][1] if shard in spans else a, b)
        rounds.append(list(spans.values()))
    return rounds


def hashed_words(vocabulary: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """shard, chunk, hash of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for length, at in by_length(words):
                shard = shard_of(length)
                step = max(1, STEP_EDITS // length)
                for s in range(0, len(at), step):
                    codes = letters_of([words[i] for i in at[s : s + step]])
                    hashes = place_values(np.arange(length), codes).sum(axis=1, dtype=np.uint64)
                    chunks = block_of(hashes, sizes[shard]) // CHUNK_BLOCKS
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hashes), shard)), pa.array(chunks), pa.array(hashes.view(np.int64))],
                        ["shard", "chunk", "hash"],
                    )

    return vocabulary.select("word").mapInArrow(run, "shard long, chunk long, hash long")


def build_filters(hashed: DataFrame, sizes: dict[int, int], spans: list[tuple[int, int, int]]) -> dict:
    """The filters of one pass: shard -> (blocks in all, first block, array of blocks).

    Chunks are built by groups of words; the driver gets their bytes, ROUND_BYTES at most.
    """

    def run(rows):
        import pandas as pd

        shard, chunk = int(rows["shard"].iloc[0]), int(rows["chunk"].iloc[0])
        hashes = rows["hash"].to_numpy().view(np.uint64)
        first = chunk * CHUNK_BLOCKS
        block = block_of(hashes, sizes[shard]) - first
        bits = np.zeros((min(CHUNK_BLOCKS, sizes[shard] - first), 8), np.uint32)
        for lane in range(8):
            np.bitwise_or.at(bits, (block, lane), lane_bits(hashes, lane))
        return pd.DataFrame({"shard": [shard], "chunk": [chunk], "bits": [bits.tobytes()]})

    wanted = F.lit(False)
    for shard, a, b in spans:
        wanted = wanted | ((F.col("shard") == shard) & F.col("chunk").between(a, b - 1))
    rows = hashed.where(wanted).groupBy("shard", "chunk").applyInPandas(run, "shard long, chunk long, bits binary").collect()
    filters = {}
    for shard, a, b in spans:
        first, end = a * CHUNK_BLOCKS, min(sizes[shard], b * CHUNK_BLOCKS)
        filters[shard] = (sizes[shard], first, np.zeros((end - first, 8), np.uint32))
    for r in rows:
        _, first, bits = filters[r["shard"]]
        part = np.frombuffer(r["bits"], np.uint32).reshape(-1, 8)
        at = r["chunk"] * CHUNK_BLOCKS - first
        bits[at : at + len(part)] = part
    return filters


def admitted(filters: dict, length: int, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter of this length admits in this pass."""
    if shard_of(length) not in filters:
        return np.empty(0, np.int64)
    blocks, first, bits = filters[shard_of(length)]
    block = block_of(hashes, blocks) - first
    alive = np.flatnonzero((block >= 0) & (block < len(bits)))
    for lane in range(8):
        alive = alive[(bits[block[alive], lane] & lane_bits(hashes[alive], lane)) != 0]
    return alive


def deletions(codes: np.ndarray, values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of the edits without one letter; of a run of equal letters only the first goes."""
    length = codes.shape[1]
    before = np.cumsum(values, axis=1, dtype=np.uint64) - values
    moved = np.zeros_like(values)
    moved[:, 1:] = place_values(np.arange(length - 1), codes[:, 1:])
    after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(fresh[:, places])
    at = places[at]
    return row, at, before[row, at] + after[row, at]


def replacements(
    codes: np.ndarray, values: np.ndarray, places: np.ndarray, alphabet: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, letter and hash of the edits with one greater letter."""
    new = place_values(places[:, None], alphabet[None, :])
    rest = values.sum(axis=1, dtype=np.uint64)[:, None] - values[:, places]
    row, at, letter = np.nonzero(alphabet[None, None, :] > codes[:, places, None])
    return row, places[at], alphabet[letter], rest[row, at] + new[at, letter]


def probe_task(shared, least_letters: int):
    """Function over Arrow batches of (word, n): the edits that the filters admit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, alphabet = shared.value
        lengths = set(filters)
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            for length, at in by_length(words):
                if not lengths & {shard_of(length), shard_of(length - 1)}:
                    continue
                group = max(1, STEP_EDITS // (length * len(alphabet)))
                span = max(1, STEP_EDITS // len(alphabet))
                for s in range(0, len(at), group):
                    some = at[s : s + group]
                    codes = letters_of([words[i] for i in some])
                    values = place_values(np.arange(length), codes)
                    for p in range(0, length, span):
                        places = np.arange(p, min(length, p + span))
                        found = []
                        if length > least_letters:
                            row, place, hashes = deletions(codes, values, places)
                            for i in admitted(filters, length - 1, hashes):
                                w = words[some[row[i]]]
                                found.append((w[: place[i]] + w[place[i] + 1 :], row[i]))
                        row, place, letter, hashes = replacements(codes, values, places, alphabet)
                        for i in admitted(filters, length, hashes):
                            w = words[some[row[i]]]
                            found.append((w[: place[i]] + bytes([letter[i]]) + w[place[i] + 1 :], row[i]))
                        if found:
                            source = some[[r for _, r in found]]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([w.decode("latin-1") for w, _ in found], pa.string()),
                                    batch.column(0).take(pa.array(source)),
                                    pa.array(counts[source], pa.int64()),
                                ],
                                ["near", "word", "n"],
                            )

    return run


def near_pairs(vocabulary: DataFrame, least_letters: int = MIN_LETTERS) -> DataFrame:
    """word, n, near, near_n: every pair of words one edit apart, once. vocabulary is a stored table."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), np.uint8)
    sizes = filter_sizes(vocabulary)
    hashed = materialize(hashed_words(vocabulary, sizes))
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = spark.createDataFrame([], "near string, word string, n long, near_n long")
    for spans in filter_ranges(sizes):
        shared = spark.sparkContext.broadcast((build_filters(hashed, sizes, spans), alphabet))
        admits = vocabulary.select("word", "n").mapInArrow(probe_task(shared, least_letters), "near string, word string, n long")
        found = found.unionByName(materialize(admits.join(exact, "near")))
        shared.unpersist()
    return found.select("word", "n", "near", "near_n")


def follow(links: DataFrame) -> DataFrame:
    """word, root: the end of each chain of word -> root links, by pointer doubling."""
    links = materialize(links)
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(lookup_join(links, ahead, ["root"], "left"))
        if step.where("next IS NOT NULL").isEmpty():
            return links
        links = materialize(step.select("word", F.coalesce("next", "root").alias("root")))


def variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_letters: int = MIN_LETTERS,
    least: int = MIN_COUNT,
    modulus: int = MODULUS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocabulary = materialize(word_counts(docs, key, text, least_letters, least, modulus))
    a, b = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = near_pairs(vocabulary, least_letters).select(F.explode(F.array(a, b)).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word")))
    around = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = F.when(-F.col("best.order") >= 2 * F.col("n"), F.col("best"))
    formed = materialize(
        vocabulary.join(around, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), strong["word"].alias("form"), (-strong["order"]).alias("form_n")
        )
    )
    roots = follow(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
