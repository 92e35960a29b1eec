"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint is cut into max_bits + 3 blocks. Two fingerprints that differ in at most max_bits
bits agree on at least three blocks, so every close pair shares the key made of some three
blocks. Pairs that share a key are verified by their Hamming distance.

Rows with a null or empty text have fingerprint zero. Equal texts, repeated rows and ties fall
onto one fingerprint. Rows without a doc_id get a fingerprint, a null component and link
nothing. An empty table gives an empty table. Columns of the input named like an output are
replaced.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellweek.llm.common import add_columns, free_name, is_small, materialize, salted_join
from cellweek.operators.components import connected_components
from cellweek.operators.skew import lookup_join

SEED = 42
# Members of a block that are compared by a join; larger blocks are cut into chunks.
SMALL_BLOCK = 64
CHUNK = 2000


def fingerprint_of(text: bytes, shingle: int) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; a bit is set where over half the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with `fingerprint`, a signed long."""

    def make(texts: list[bytes]) -> list[list]:
        return [[fingerprint_of(x, shingle) for x in texts]]

    field = T.StructField("fingerprint", T.LongType(), False)
    return add_columns(docs, text, [field], make, docs.columns if keep is None else keep)


def fingerprint_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def block_masks(max_bits: int) -> list[int]:
    """Signed masks, one for each choice of three of the max_bits + 3 blocks."""
    n = max_bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Positions of linked pairs that connect what is connected within the values, one pair a step."""
    links, left = [], np.arange(len(values))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= max_bits
            links += [(at, x) for x in left[near]]
            frontier += list(left[near])
            left = left[~near]
    return links


def close_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """a, b: links between ids of prints(id, fingerprint), which hold distinct fingerprints.

    Small blocks are joined with themselves. Large ones are dealt into chunks by a hash; every
    two chunks meet in one task, which returns a spanning set of their links and not all pairs.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(block_masks(max_bits))])
    keys = prints.select("id", "fingerprint", F.explode(masks).alias("_m")).select(
        F.col("_m.choice").alias("choice"), F.col("fingerprint").bitwiseAND(F.col("_m.mask")).alias("key"), "id", "fingerprint"
    )
    block = Window.partitionBy("choice", "key")
    shared = materialize(keys.withColumn("n", F.count(F.lit(1)).over(block)).where("n > 1"))

    small = shared.where(F.col("n") <= SMALL_BLOCK)
    other = small.select("choice", "key", F.col("id").alias("b"), F.col("fingerprint").alias("_other"))
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("_other"))) <= max_bits
    pairs = small.join(other, ["choice", "key"]).where((F.col("fingerprint") < F.col("_other")) & close)

    chunks = F.ceil(F.col("n") / CHUNK)
    large = (
        shared.where(F.col("n") > SMALL_BLOCK)
        .withColumn("_own", F.pmod(F.xxhash64("fingerprint"), chunks))
        .withColumn("_with", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        .select("choice", "key", F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), "id", "fingerprint")
    )

    def link(block: pd.DataFrame) -> pd.DataFrame:
        ids = block["id"].to_numpy()
        found = spanning_links(block["fingerprint"].to_numpy().view(np.uint64), max_bits)
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["a", "b"], dtype="int64")

    wide = large.groupBy("choice", "key", "i", "j").applyInPandas(link, "a long, b long")
    return pairs.select(F.col("id").alias("a"), "b").unionAll(wide)


def grouped(source: DataFrame, keep: list[str], shingle: int, max_bits: int) -> DataFrame:
    """The kept columns of (doc_id, text, ...) rows with fingerprint, root and component_id.

    Nodes are fingerprints, so rows of one doc_id with different texts stay apart. root names the
    group of close fingerprints, component_id is the smallest doc_id in it. Stored.
    """
    found = materialize(fingerprints(source, "text", shingle, keep))
    prints = materialize(
        found.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("first"))
    )
    links = materialize(close_links(prints.select(F.col("fingerprint").alias("id"), "fingerprint"), max_bits))
    # Only linked fingerprints take part in the rounds; the others are groups of their own.
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = connected_components(linked, links).select(F.col("node").alias("fingerprint"), "root")
    members = materialize(prints.join(roots, "fingerprint"))
    smallest = members.groupBy("root").agg(F.min("first").alias("_first"))
    named = lookup_join(members, smallest, ["root"]).select("fingerprint", "root", "_first")
    table = materialize(
        prints.join(named, "fingerprint", "left").select(
            "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("_first", "first").alias("component_id")
        )
    )
    joined = found.join(F.broadcast(table), "fingerprint", "left") if is_small(table) else salted_join(found, table, ["fingerprint"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.withColumn("component_id", own)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable over close fingerprints."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return grouped(source, ["doc_id"], shingle, max_bits).select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each group, one with the smallest doc_id; rows without a doc_id stay.

    Rows are told apart by doc_id and text, so texts that share a doc_id are judged by their own
    groups. Rows repeated in both count as copies, of which one stays.
    """
    copy = free_name(docs.columns, "_copy")
    marked = docs.withColumn(copy, F.xxhash64(text))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    found = materialize(grouped(source, ["doc_id", "copy"], shingle, max_bits)).where("doc_id IS NOT NULL")
    first = found.where("doc_id = component_id")
    several = materialize(first.groupBy("root").agg(F.min("copy").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    others = lookup_join(first, several, ["root"], stored=True).where("copy <> _kept")
    late = found.where("doc_id <> component_id")
    dropped = materialize(
        late.unionByName(others, allowMissingColumns=True).select(F.col("doc_id").alias(doc_id), F.col("copy").alias(copy)).distinct()
    )
    kept = marked.join(F.broadcast(dropped) if is_small(dropped) else dropped, [doc_id, copy], "left_anti")
    if not several.isEmpty():
        named = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, copy])
        kept = named.unionByName(kept.where(F.col(doc_id).isNull()))
    return kept.select(*docs.columns)


__all__ = ["block_masks", "close_links", "drop_near_copies", "fingerprint_of", "fingerprint_text", "fingerprints", "grouped", "groups", "spanning_links"]
