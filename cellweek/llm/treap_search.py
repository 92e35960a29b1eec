"""Ranked lexical search over a K2-treap of the term-document grid.

Rows of the grid are terms, columns are documents, and a cell holds the impact of the term in the
document: its weight times the saturated, length-corrected number of occurrences. A K2-treap is
the compressed quadtree of that grid: every quadrant that holds a cell keeps the greatest impact
in it, a mask of four bits says which of its quadrants hold cells, and the running number of set
bits finds the children, so empty quadrants and coordinates take no space.

An item is the set of its rows. Over a range of documents it stands at one quadrant per row, and
the sum of their maxima bounds the score of every document of the range. The rows descend jointly
into the halves of the range, best bounds first, until no range can hold a better document than
the k best found. Bounds of single documents are exact scores.

Documents are read once for their terms; only terms that some item asks for enter the grid, with
exact document frequencies and lengths over the whole table. Each task builds treaps over blocks
of its documents, keeps k documents per item, and the lists of all tasks meet in one ranking.
Items go to the tasks in groups of bounded size, one pass over the documents for each.

Defined cases. Null or empty texts hold no term and are in no statistic; such items have no rows.
Every row of the documents is a document of its own, also if ids repeat; null ids come last among
equal scores. Items that repeat in id and text are asked once; a null item id is kept. Ties go to
the smaller id, then to any of the rows that share it. Empty tables give no rows. Other columns
are not read. Inside, the greatest long stands for a null id and comes out as null.
"""

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweek.llm.common import bounded_groups, materialize, utf8
from cellweek.sources.scratch import scratch_path

K = 20
# Constants of the score: fixed values.
LENGTH_PART, SATURATION, SCALE = 25, 12, 1000
# Bytes of item terms that one pass answers.
ITEM_BYTES = 4 * 1024 * 1024
# Documents, cells and bytes of search state of one treap, and quadrants widened in one step.
BLOCK_DOCS, BLOCK_CELLS, STATE_BYTES, STEP_CELLS = 1 << 14, 1 << 21, 1 << 28, 1 << 13
LAST_ID = 2**63 - 1
FOUND = "item_no long, item_id long, doc_id long, score long"
# What splits terms is all of ASCII but letters and digits; A-Z are folded.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256)
)
# By mask and quadrant: whether the quadrant is set, and how many lower ones are.
_SET = np.array([[m >> q & 1 for q in range(4)] for m in range(16)], bool)
_BELOW = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.int32)


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text. All bytes of letters beyond ASCII belong to terms."""
    return text.translate(_FOLD).split()


def pack_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_no, item_id, terms (joined by spaces) of the distinct items, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = pa.array([b" ".join(terms(t)) for t in utf8(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), joined], ["item_no", "item_id", "terms"])

    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    numbered = rows.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "text")
    return materialize(materialize(numbered).mapInArrow(run, "item_no long, item_id long, terms binary"))


def occurrences(docs: DataFrame, key: str, text: str, wanted) -> DataFrame:
    """doc_id, n, terms, tfs: length and the wanted terms' occurrences of every document that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = wanted.value
        for batch in batches:
            kept, sizes, rows, times = [], [], [], []
            for i, body in enumerate(utf8(batch.column(1))):
                found = terms(body)
                if not found:
                    continue
                counts = Counter(t for t in found if t in numbers)
                kept.append(i)
                sizes.append(len(found))
                rows.append([numbers[t] for t in counts])
                times.append(list(counts.values()))
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each cell from its term's weight, its occurrences and its document's length."""
    if len(lengths) and LENGTH_PART * int(lengths.max()) * n_docs < 2**63:
        part = LENGTH_PART * lengths * n_docs // n_terms
    else:
        part = np.array([LENGTH_PART * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return weights * (1_000_000_000 * tfs // (SCALE * tfs + SATURATION * (100 - LENGTH_PART + part)))


class Treap:
    """K2-treap of distinct cells (row, column, impact).

    value and mask hold all quadrants, level after level from the whole grid to single cells,
    and one empty quadrant at the end; first is the place of a quadrant's first child.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impact: np.ndarray, n_rows: int, n_columns: int):
        self.height = max(1, (max(n_rows, n_columns) - 1).bit_length())
        code = np.zeros(len(rows), np.int64)
        for b in range(self.height):
            code |= (columns >> b & 1) << (2 * b) | (rows >> b & 1) << (2 * b + 1)
        order = np.argsort(code)
        code, values = code[order], impact[order].astype(np.int64)
        levels = [(values, np.zeros(len(values), np.uint8), np.zeros(len(values), np.int64))]
        for _ in range(self.height):
            parent = code >> 2
            starts = np.flatnonzero(np.diff(parent, prepend=-1))
            masks = np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), starts)
            values = np.maximum.reduceat(values, starts)
            levels.append((values, masks, starts))
            code = parent[starts]
        levels.reverse()
        offsets = np.cumsum([0] + [len(v) for v, _, _ in levels])
        self.empty = int(offsets[-1])
        self.value = np.concatenate([*(v for v, _, _ in levels), [0]])
        self.mask = np.concatenate([*(m for _, m, _ in levels), [0]]).astype(np.uint8)
        self.first = np.concatenate([*(s + o for (_, _, s), o in zip(levels, offsets[1:], strict=True)), [0]]).astype(np.int32)

    def child(self, nodes: np.ndarray, quadrants: np.ndarray) -> np.ndarray:
        """The quadrants' places, that of the empty one where they hold no cell."""
        masks = self.mask[nodes]
        return np.where(_SET[masks, quadrants], self.first[nodes] + _BELOW[masks, quadrants], self.empty).astype(np.int32)

    def best(self, rows: np.ndarray, times: np.ndarray, ids: np.ndarray, top: "Top") -> None:
        """Offers the documents of this grid to the list of one item, best ranges first.

        ids are the documents' ids in column order, which is their rising order.
        """
        step = max(1, STEP_CELLS // len(rows))
        start = np.array([int(times.sum()) * int(self.value[0])])
        # Ranges of one level, best first: bounds, places in their level and quadrants per row.
        heap = [(-int(start[0]), 0, 0, start, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32))]
        serial = 0
        while heap:
            _, _, level, bounds, places, nodes = heapq.heappop(heap)
            alive = top.admits(bounds, ids[places << (self.height - level)])
            bounds, places, nodes = bounds[alive], places[alive], nodes[alive]
            if not len(bounds):
                continue
            if len(bounds) > step:
                serial += 1
                heapq.heappush(heap, (-int(bounds[step]), serial, level, bounds[step:], places[step:], nodes[step:]))
                places, nodes = places[:step], nodes[:step]
            row_bit = rows >> (self.height - 1 - level) & 1
            halves = [self.child(nodes, 2 * row_bit + half) for half in (0, 1)]
            below = np.concatenate(halves)
            places = np.concatenate([2 * places, 2 * places + 1])
            bounds = self.value[below] @ times
            if level + 1 == self.height:
                held = bounds > 0
                top.offer(bounds[held], ids[places[held]])
                continue
            held = np.flatnonzero(top.admits(bounds, ids[places << (self.height - level - 1)]))
            if len(held):
                held = held[np.argsort(-bounds[held], kind="stable")]
                serial += 1
                heapq.heappush(heap, (-int(bounds[held[0]]), serial, level + 1, bounds[held], places[held], below[held]))


class Top:
    """The k best documents so far, by falling score, then rising id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def admits(self, bounds: np.ndarray, first_ids: np.ndarray) -> np.ndarray:
        """Ranges that may hold a better document; first_ids are their smallest ids."""
        if len(self.ids) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (first_ids < self.ids[-1]))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_task(shared, k: int):
    """Function over Arrow batches of occurrences: the best documents of each item there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        tops = [Top(k) for _ in items]
        widest = max(len(rows) for _, _, rows, _ in items)
        most_docs = max(64, min(BLOCK_DOCS, STATE_BYTES // (8 * widest)))

        def search(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            column = np.empty(len(ids), np.int64)
            column[order] = np.arange(len(ids))
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = impacts(weights[term], tf, lengths[doc], n_docs, n_terms)
            term, doc, impact = term[impact > 0], doc[impact > 0], impact[impact > 0]
            if not len(term):
                return
            # Terms of like greatest impact are neighbours, so that upper quadrants bound well.
            present, row = np.unique(term, return_inverse=True)
            peak = np.zeros(len(present), np.int64)
            np.maximum.at(peak, row, impact)
            rank = np.empty(len(present), np.int64)
            rank[np.argsort(-peak, kind="stable")] = np.arange(len(present))
            treap = Treap(rank[row], column[doc], impact, len(present), len(ids))
            last = np.concatenate([ids[order], np.full((1 << treap.height) - len(ids), LAST_ID)])
            place = np.full(len(weights), -1, np.int64)
            place[present] = rank
            for top, (_, _, rows, times) in zip(tops, items, strict=True):
                here = place[rows] >= 0
                if here.any():
                    treap.best(place[rows[here]], times[here], last, top)

        held: list = []
        docs = cells = 0
        for batch in batches:
            start = 0
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            ends = np.cumsum(sizes)
            while start < batch.num_rows:
                base = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, base + BLOCK_CELLS - cells, "right"))
                stop = min(batch.num_rows, start + most_docs - docs, max(stop, start + (not held)))
                if stop > start:
                    part = batch.slice(start, stop - start)
                    ids = part.column(0).fill_null(LAST_ID).to_numpy()
                    held.append((ids, part.column(1).to_numpy(), sizes[start:stop], part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                    docs, cells = docs + stop - start, cells + int(ends[stop - 1]) - base
                    start = stop
                if start < batch.num_rows or docs >= most_docs or cells >= BLOCK_CELLS:
                    search(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, docs, cells = [], 0, 0
        if held:
            search(*(np.concatenate(c) for c in zip(*held, strict=True)))
        found = [len(t.ids) for t in tops]
        if sum(found):
            ids = np.concatenate([t.ids for t in tops])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([i[0] for i in items], found), pa.int64()),
                    pa.array([i[1] for i, n in zip(items, found, strict=True) for _ in range(n)], pa.int64()),
                    pa.array(ids, pa.int64(), mask=ids == LAST_ID),
                    pa.array(np.concatenate([t.scores for t in tops]), pa.int64()),
                ],
                ["item_no", "item_id", "doc_id", "score"],
            )

    return run


def search_group(docs: DataFrame, key: str, text: str, group: list, k: int) -> DataFrame:
    """The best documents that each task finds for the items of one group."""
    spark = docs.sparkSession
    asked = [(r["item_no"], r["item_id"], Counter(bytes(r["terms"]).split())) for r in group]
    numbers = {t: i for i, t in enumerate(dict.fromkeys(t for _, _, counts in asked for t in counts))}
    wanted = spark.sparkContext.broadcast(numbers)
    table = materialize(occurrences(docs, key, text, wanted))
    wanted.unpersist()
    total = table.agg(F.count("n").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    # One number per term of the group.
    frequency = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(numbers), np.int64)
    for r in frequency:
        weights[r["term"]] = weight(total["n_docs"], r["count"])
    items = []
    for number, name, counts in asked:
        rows = np.array([numbers[t] for t in counts], np.int64)
        items.append((number, name, rows, np.array(list(counts.values()), np.int64)))
    shared = spark.sparkContext.broadcast((items, weights, total["n_docs"], total["n_terms"]))
    held = table.where(F.size("terms") > 0)
    found = materialize(held.mapInArrow(search_task(shared, k), FOUND))
    shared.unpersist()
    return found


def search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item with scores above 0."""
    spark = docs.sparkSession
    packed = pack_items(items, item_key, item_text).where(F.length("terms") > 0)
    path = scratch_path(spark)
    spark.createDataFrame([], FOUND).write.parquet(path)
    for group in bounded_groups(packed.toLocalIterator(), lambda r: len(r["terms"]), ITEM_BYTES):
        search_group(docs, key, text, group, k).write.mode("append").parquet(path)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        spark.read.schema(FOUND)
        .parquet(path)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
