"""Removal of lines that occur in many documents, by two Bloom filters and an exact count.

1. Every partition emits the hashes of its distinct lines, and which it saw in two documents.
2. The hashes are dealt to shards. A shard streams its hashes through a filter of lines seen
   once; what is already in it goes into a filter of lines seen twice. The shards' second
   filters make up one filter of fixed size.
3. Only lines in that filter are shuffled, with counts per partition, and counted exactly by
   their text. False positives of the filters cost a little shuffle and change no result.
4. Every text loses its repeated lines. The list of repeated lines is broadcast if its counted
   size allows it and joined otherwise.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. A null
or empty text is one empty line and stays an empty text. Every row counts as one document, so a
repeated row counts again. An empty table gives an empty table. Columns named like an output are
replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweek.llm.common import add_columns, free_name, is_small, materialize, salted_join, text_column, utf8

# Bits of the broadcast filter: 8 MB. More repeated lines than it can tell apart only add shuffle.
TWICE_BITS = 1 << 26
# Hashes per shard, bits per hash of the filters of lines seen once, and probes per hash.
SHARD_ROWS = 1 << 19
BITS_PER_LINE = 16
PROBES = 4
# Entries that a partition gathers before it passes them on.
GATHERED = 400_000


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip().lower() for line in text.split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _hashes(keys: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(k) for k in keys], dtype=np.uint64)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of every hash, one row each; the high bits choose the shard and stay unused."""
    first = hashes & np.uint64(0xFFFFFFFF)
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    return ((first[:, None] + i * (step & np.uint64(0xFFFFFFFF))[:, None]) % np.uint64(bits)).astype(np.int64)


def _has(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _put(filled: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filled, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % shards


def local_hashes(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """h, again: the hashes of each partition's lines, and whether two of its documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}

        def flush() -> pa.RecordBatch:
            h = np.fromiter(seen.keys(), dtype=np.uint64, count=len(seen)).view(np.int64)
            again = np.fromiter(seen.values(), dtype=bool, count=len(seen))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(again)], names=["h", "again"])

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for raw in utf8(batch.column(0)):
                for key in set(line_keys(raw)):
                    if _long_enough(key, min_chars):
                        h = digest(key)
                        seen[h] = h in seen
                if len(seen) >= GATHERED:
                    yield flush()
                    seen.clear()
        yield flush()

    return docs.select(text_column(text).alias("t")).mapInArrow(run, "h long, again boolean")


def twice_filter(hashes: DataFrame, bits: int = TWICE_BITS) -> tuple[np.ndarray, int]:
    """The filter of lines seen at least twice, and its number of shards; hashes is a stored table."""
    rows = hashes.count()
    shards = 1 << max(3, (max(rows, 1) // SHARD_ROWS).bit_length())
    shards = min(shards, bits // 64)
    own = bits // shards
    once_bits = max(1 << 12, BITS_PER_LINE * rows // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            h = batch.column(1).to_numpy().view(np.uint64)
            again = batch.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(part):
                mine = part == s
                if s not in once:
                    once[s] = np.zeros(once_bits // 8 + 1, np.uint8)
                    twice[s] = np.zeros(own // 8, np.uint8)
                values, back, counts = np.unique(h[mine], return_inverse=True, return_counts=True)
                more = counts > 1
                np.logical_or.at(more, back, again[mine])
                at = _probes(values, once_bits)
                repeat = _has(once[s], at) | more
                _put(twice[s], _probes(values[repeat], own))
                _put(once[s], at[~repeat])
                _put(once[s], at[repeat])
        names = ["shard", "filled"]
        yield pa.RecordBatch.from_arrays([pa.array([int(k) for k in twice], pa.int64()), pa.array([v.tobytes() for v in twice.values()], pa.binary())], names=names)

    shard = F.pmod(F.shiftrightunsigned("h", 40), F.lit(shards))
    dealt = hashes.select(shard.cast("long").alias("shard"), "h", "again").repartition(shards, "shard")
    filled = np.zeros((shards, own // 8), np.uint8)
    for row in dealt.mapInArrow(run, "shard long, filled binary").toLocalIterator():
        filled[row["shard"]] = np.frombuffer(row["filled"], np.uint8)
    return filled.ravel(), shards


def repeated_lines(docs: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int, bits: int = TWICE_BITS) -> DataFrame:
    """key, n_docs, first_id, first_line of every line in at least min_docs rows, as a stored table."""
    spark = docs.sparkSession
    filled, shards = twice_filter(materialize(local_hashes(docs, text, min_chars)), bits)
    own = bits // shards
    shared = spark.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, tuple[int, tuple]] = {}
        names = ["key", "n", "first_id", "first_line"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            rows = [(k.decode(), n, None if p[0] else p[1], p[2]) for k, (n, p) in counts.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            firsts: list[tuple[bytes, int, int]] = []
            ids = batch.column(0).to_pylist()
            for i, raw in zip(ids, utf8(batch.column(1)), strict=True):
                places: dict[bytes, int] = {}
                for n, key in enumerate(line_keys(raw)):
                    if key not in places and _long_enough(key, min_chars):
                        places[key] = n
                firsts += [(k, i, n) for k, n in places.items()]
            if not firsts:
                continue
            h = _hashes([x[0] for x in firsts])
            base = _shard(h, shards) * own
            suspect = _has(shared.value, _probes(h, own) + base[:, None])
            for at in np.flatnonzero(suspect):
                key, i, n = firsts[at]
                place = (i is None, i or 0, n)
                known = counts.get(key)
                counts[key] = (1, place) if known is None else (known[0] + 1, min(known[1], place))
            if len(counts) >= GATHERED:
                yield flush()
                counts.clear()
        yield flush()

    source = docs.select(F.col(doc_id).cast("long"), text_column(text))
    partial = source.mapInArrow(run, "key string, n long, first_id long, first_line long")
    place = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id"), F.col("first_line"))
    total = partial.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(place).alias("_p"))
    kept = total.where(F.col("n_docs") >= min_docs)
    return materialize(kept.select("key", "n_docs", F.col("_p.first_id").alias("first_id"), F.col("_p.first_line").alias("first_line")))


_FIELDS = [
    T.StructField("text", T.StringType(), False),
    T.StructField("n_lines", T.LongType(), False),
    T.StructField("n_dropped", T.LongType(), False),
]


def _without(raw: bytes, gone) -> tuple[str, int, int]:
    """The text without the lines for which gone(position, key) holds."""
    lines = raw.split(b"\n")
    kept = [line for n, line in enumerate(lines) if not gone(n, line.strip().lower())]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    first: bool = False,
    small: int = 200_000,
    bits: int = TWICE_BITS,
) -> DataFrame:
    """The documents with their text shortened, and n_lines (before) and n_dropped.

    Lines found in at least min_docs documents go everywhere; with first=True the first place
    of each stays, that is the smallest doc_id (null last) and line.
    """
    found = repeated_lines(docs, doc_id, text, min_docs, min_chars, bits)
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    order = [*(c for c in docs.columns if c in (*others, text)), "n_lines", "n_dropped"]
    fields = [T.StructField(text, T.StringType(), False), *_FIELDS[1:]]
    if is_small(found, small):
        table = {r["key"].encode(): (r["first_id"], r["first_line"]) for r in found.toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(table)
        if not first:

            def make(texts: list[bytes]) -> list[list]:
                known = shared.value
                rows = [_without(raw, lambda n, key: key in known) for raw in texts]
                return [list(c) for c in zip(*rows, strict=True)]

            return add_columns(docs, text, fields, make, others).select(*order)
    places = materialize(_places(docs, doc_id, text, found, first))
    return _apply_places(docs, text, places, fields, others).select(*order)


def _row_key(docs: DataFrame):
    """A hash of the whole row; equal rows have equal lines, so they may share it."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in docs.columns])), 256)


def _places(docs: DataFrame, doc_id: str, text: str, found: DataFrame, first: bool) -> DataFrame:
    """_row, gone: positions of the lines to drop, for rows that have any."""
    lines = docs.select(
        _row_key(docs).alias("_row"),
        F.col(doc_id).cast("long").alias("_id"),
        F.posexplode(F.split(text_column(text), "\n")).alias("_pos", "_line"),
    )
    key = F.regexp_replace(F.translate("_line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    hits = salted_join(lines.select("_row", "_id", "_pos", key.alias("key")), found.select("key", "first_id", "first_line"), ["key"])
    if first:
        hits = hits.where(~(F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_pos") == F.col("first_line"))))
    return hits.groupBy("_row").agg(F.collect_set("_pos").alias("gone"))


def _apply_places(docs: DataFrame, text: str, places: DataFrame, fields: list[T.StructField], others: list[str]) -> DataFrame:
    row, gone, body = (free_name(docs.columns, x) for x in ("_row", "_gone", "_text"))
    joined = docs.withColumn(row, _row_key(docs))
    joined = salted_join(joined, places.select(F.col("_row").alias(row), F.col("gone").alias(gone)), [row], "left")
    source = joined.select(*others, text_column(text).alias(body), F.coalesce(gone, F.array().cast("array<int>")).alias(gone))
    schema = T.StructType([*docs.select(*others).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, away in zip(utf8(batch.column(body)), batch.column(gone).to_pylist(), strict=True):
                drop = set(away)
                rows.append(_without(raw, lambda n, key, drop=drop: n in drop))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)
