"""Document fingerprints by content-defined chunking.

A gear hash over the bytes of the UTF-8 text proposes boundaries. Chunk sizes are normalised:
up to the usual size only a strict mask cuts, beyond it a loose one, and at the largest size a
cut is forced. A change moves the boundaries near it only, so other chunks keep their digests.
A fingerprint is the set of chunk digests with chunk lengths; likeness is containment, the
length of the shared chunks over the length of the smaller set.

Two empty fingerprints have likeness 1, an empty and another one 0. Null texts are empty. The
order for the next document is descending doc_id, then text; rows without doc_id come last.
For it the rows are dealt to ranges of this order, split at ids and heads of texts, so neither
many rows without id nor many rows of one id share a range, unless their texts start alike.
Repeated rows follow each other. The next document after the last is the first. An empty table
gives an empty table. Extra columns are ignored.
"""

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweek.llm.common import materialize, text_column, utf8

LEAST, USUAL, MOST = 12, 32, 128
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
# Rows and bytes of text per range; the driver knows the key of the first row of every range.
RANGE_ROWS, RANGE_BYTES = 100_000, 64 * 1024 * 1024
# Bytes of the text in a key, after nine for the id.
HEAD = 48
_REACH = 32
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 77) for i in range(256)], dtype=np.uint32)


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one at its end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    rolled = GEAR[np.frombuffer(text, np.uint8)]
    step = 1
    while step < _REACH:
        moved = rolled.copy()
        moved[step:] += rolled[:-step] << np.uint32(step)
        rolled, step = moved, 2 * step
    strict = (np.flatnonzero((rolled & STRICT) == 0) + 1).tolist()
    loose = (np.flatnonzero((rolled & LOOSE) == 0) + 1).tolist()
    ends, start = [], 0
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST)
        end = strict[i] if i < len(strict) else n
        if end > start + USUAL:
            i = bisect_left(loose, start + USUAL)
            end = min(loose[i] if i < len(loose) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: bytes) -> dict[int, int]:
    """Chunk digests with chunk lengths."""
    found, start = {}, 0
    for end in cut_points(text):
        found[xxhash.xxh32_intdigest(text[start:end])] = end - start
        start = end
    return found


def print_text(chunks: dict[int, int]) -> str:
    """Ten hex digits for each chunk, ordered: its digest and length."""
    packed = sorted((d << 8) | n for d, n in chunks.items())
    return b"".join(x.to_bytes(5, "big") for x in packed).hex()


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[d] for d in a.keys() & b.keys())
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def _order_key() -> Column:
    """Bytes that sort as descending doc_id, rows without id last, then the start of the text."""
    reverse = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit((1 << 63) - 1))), 16, "0")
    place = F.unhex(F.coalesce(F.concat(F.lit("00"), reverse), F.lit("01" + "0" * 16)))
    return F.concat(place, F.substring(F.encode("text", "UTF-8"), 1, HEAD))


def _first_keys(source: DataFrame) -> np.ndarray:
    """The key of the first row of every range, in order; found from the stored keys."""
    keys = materialize(source.select(_order_key().alias("key"), F.octet_length("text").alias("size")))
    rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(1, -(-rows // RANGE_ROWS), -(-size // RANGE_BYTES))
    ranges = keys.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return np.unique(np.array([bytes(r.key) for r in ranges.collect()], dtype=f"S{9 + HEAD}"))


def _followed(source: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their range, each range closed by a copy of the row that follows it."""
    firsts = _first_keys(source)

    @F.pandas_udf("range int, closes int")
    def deal(keys: pd.Series) -> pd.DataFrame:
        held = np.array(keys.tolist(), dtype=firsts.dtype)
        at = np.searchsorted(firsts, held, "right") - 1
        # The first rows of a range close the one before; those of the first range the last.
        closes = np.where(firsts[at] == held, (at - 1) % len(firsts), -1)
        return pd.DataFrame({"range": at.astype("int32"), "closes": closes.astype("int32")})

    place = lambda name, copy: F.struct(F.col(f"dealt.{name}").alias("range"), F.lit(copy).alias("copy"))
    own = place("range", 0)
    places = F.when(F.col("dealt.closes") >= 0, F.array(own, place("closes", 1))).otherwise(F.array(own))
    dealt = source.withColumn("dealt", deal(_order_key())).select("doc_id", "text", F.inline(places))
    return dealt, max(1, len(firsts))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many, or all, of
    the next document's first.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    rows, ranges = _followed(source)
    dealt = rows.repartitionById(ranges, "range").sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "text")

    def row(now: tuple, after: tuple) -> tuple:
        own, chars, chunks = now[2], now[3], now[4]
        body = own.decode()
        half = chars // 2
        edited = (body[: chars - half] + after[2].decode()[:half]).encode()
        changed = chunk_set(edited)
        digest = hashlib.sha256(edited).hexdigest()
        return (now[1], chars, digest, print_text(chunks), print_text(changed), likeness(chunks, changed), likeness(chunks, after[4]))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        size = 0
        for batch in batches:
            info = zip(batch.column("range").to_pylist(), batch.column("copy").to_pylist(), batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True)
            for part, copy, i, raw in info:
                if last is not None and not last[5] and last[0] != part:
                    raise ValueError("a range of rows is not closed")
                if last is not None and last[5] and copy and last[0] == part:
                    continue
                now = (part, i, raw, len(raw.decode()), chunk_set(raw), bool(copy))
                if last is not None and not last[5]:
                    out.append(row(last, now))
                    size += len(last[2])
                    if size > 4_000_000 or len(out) >= 5000:
                        yield flush()
                        out.clear()
                        size = 0
                last = now
        yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
