"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Every component x of a vector becomes the integer floor(scale * x), x as double; its place in
the vector is the term. A block of candidates is held as postings, for each term the rows that
hold it and their values. A query is the sparse row of its non-zero components: term by term its
weight times the posting is scattered into a dense array with one score per candidate of the
block. From that array a partition selection takes the best, which are merged with the best of
the blocks before; the lists of all tasks meet in one ranking per query.

Queries are rows of the table itself. They are packed into bounded groups; each group goes to all
tasks at once and one pass over the candidates answers it. No pair is written: a task leaves at
most k rows per query. The number of passes grows with the queries, as the work does.

Defined cases. Vectors that are null or hold a null or non-finite component take no part; neither
do rows without an id, which cannot be named. A shorter vector counts as ending in zeros, an empty
one scores 0 with all. A candidate with the query's id is the query's own row. Repeated rows are
candidates of their own, and a repeated query row is answered once for each. Ties go to the
smaller id. A component beyond the range of a long is cut to it, and sums wrap as longs do. An
empty table gives no rows. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweek.llm.common import bounded_groups, materialize
from cellweek.sources.scratch import scratch_path

SCALE = 256
K = 5
# Candidates in one dense score array.
BLOCK = 8192
# Components in one packed row, and bytes of packed queries that one pass answers.
PACK_COMPONENTS = 128 * 1024
QUERY_BYTES = 8 * 1024 * 1024
FOUND = "query_no long, query_id long, vec_id long, score long"


def sparse_rows(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, and row, term and value of their non-zero components in row order."""
    n = len(vectors)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.repeat(np.arange(n), lengths)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    usable = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    finite = np.isfinite(values)
    usable[rows[~finite]] = False
    with np.errstate(over="ignore"):
        whole = np.floor(np.where(finite, values, 0.0) * scale)
    whole = np.clip(whole, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    kept = usable[rows] & (whole != 0)
    return usable, rows[kept], terms[kept].astype(np.int32), whole[kept]


def pack_queries(rows: DataFrame, scale: int) -> DataFrame:
    """The query rows (query_no, query_id, vector) as a stored table of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, row, term, value = sparse_rows(batch.column(2), scale)
            number = batch.column(0).to_numpy(zero_copy_only=False)[usable]
            ids = batch.column(1).to_numpy(zero_copy_only=False)[usable]
            ends = np.cumsum(np.bincount(row, minlength=len(usable))[usable])
            start = 0
            while start < len(ids):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + PACK_COMPONENTS, "right")))
                part = slice(base, ends[stop - 1])
                packed = [number[start:stop], ids[start:stop], ends[start:stop] - base, term[part], value[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in packed], ["number", "ids", "ends", "terms", "vals"]
                )
                start = stop

    return materialize(rows.mapInArrow(run, "number binary, ids binary, ends binary, terms binary, vals binary"))


class Queries:
    """Query rows of some packed rows."""

    def __init__(self, packed: list):
        self.number = np.concatenate([np.frombuffer(p["number"], np.int64) for p in packed])
        self.ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in packed])
        self.terms, self.values = [], []
        for p in packed:
            cuts = np.frombuffer(p["ends"], np.int64)[:-1]
            self.terms += np.split(np.frombuffer(p["terms"], np.int32), cuts)
            self.values += np.split(np.frombuffer(p["vals"], np.int64), cuts)
        self.largest = max((int(np.abs(v.astype(np.float64)).max()) for v in self.values if len(v)), default=0)


class Block:
    """Candidates in order of their ids, with one posting per term.

    Where half of the rows or more hold a term, its posting is a full array with zeros.
    """

    def __init__(self, ids: np.ndarray, vectors: pa.Array, queries: Queries, scale: int):
        usable, row, term, value = sparse_rows(vectors, scale)
        ids = ids[usable]
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(usable), np.int64)
        place[np.flatnonzero(usable)[order]] = np.arange(len(order))
        by_term = np.argsort(term, kind="stable")
        row, term, value = place[row][by_term], term[by_term], value[by_term]
        # The narrowest integers in which no score can overflow; beyond longs, sums wrap.
        most = float(np.abs(value.astype(np.float64)).max()) if len(value) else 0.0
        n_terms = int(term[-1]) + 1 if len(term) else 0
        self.kind = np.int32 if most * queries.largest * n_terms < 2.0**31 else np.int64
        self.postings = {}
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(term)], strict=True):
            rows, values = row[a:b], value[a:b].astype(self.kind)
            if 2 * len(rows) >= len(self.ids):
                full = np.zeros(len(self.ids), self.kind)
                full[rows] = values
                rows, values = None, full
            self.postings[int(term[a])] = (rows, values)

    def scores(self, terms: np.ndarray, weights: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
        """One query's scores of all candidates, accumulated term by term into out."""
        out[:] = 0
        for term, weight in zip(terms.tolist(), weights.astype(self.kind), strict=True):
            rows, values = self.postings.get(term, (None, None))
            if values is None:
                continue
            if rows is None:
                np.multiply(values, weight, out=spare)
                out += spare
            else:
                out[rows] += values * weight


class Best:
    """The k best candidates of each query so far, by falling score, then rising id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * n
        self.ids = [np.empty(0, np.int64)] * n

    def add(self, q: int, own: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.ids[q]) == self.k:
            chosen = np.flatnonzero(scores >= self.scores[q][-1])
        else:
            chosen = np.arange(len(scores))
        if not len(chosen):
            return
        left, right = np.searchsorted(ids, [own, own + 1]) if own < 2**63 - 1 else (np.searchsorted(ids, own), len(ids))
        wanted = self.k + int(right - left)
        if len(chosen) > 4 * wanted:
            some = scores[chosen]
            least = np.partition(some, len(some) - wanted)[len(some) - wanted]
            above, equal = chosen[some > least], chosen[some == least]
            # Rows stand in order of their ids, so the first of the equal ones come first.
            chosen = np.concatenate([above, equal[: wanted - len(above)]])
        chosen = chosen[(chosen < left) | (chosen >= right)]
        all_scores = np.concatenate([self.scores[q], scores[chosen].astype(np.int64)])
        all_ids = np.concatenate([self.ids[q], ids[chosen]])
        order = np.lexsort((all_ids, ~all_scores))[: self.k]
        self.scores[q], self.ids[q] = all_scores[order], all_ids[order]


def search_task(shared, k: int, scale: int):
    """Function over the Arrow batches of one task's candidates: the best of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(shared.value)
        best = Best(len(queries.ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                block = Block(part.column(0).to_numpy(zero_copy_only=False), part.column(1), queries, scale)
                out, spare = np.empty(len(block.ids), block.kind), np.empty(len(block.ids), block.kind)
                for q, own in enumerate(queries.ids.tolist()):
                    block.scores(queries.terms[q], queries.values[q], out, spare)
                    best.add(q, own, out, block.ids)
        sizes = [len(i) for i in best.ids]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries.number, sizes)),
                    pa.array(np.repeat(queries.ids, sizes)),
                    pa.array(np.concatenate(best.ids)),
                    pa.array(np.concatenate(best.scores)),
                ],
                ["query_no", "query_id", "vec_id", "score"],
            )

    return run


def search(
    table: DataFrame, queries: Column, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row chosen by `queries`."""
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull())
    asked = rows.where("asks").select(F.monotonically_increasing_id().alias("query_no"), "id", "vector")
    path = scratch_path(spark)
    spark.createDataFrame([], FOUND).write.parquet(path)
    packed = pack_queries(asked, scale)
    for group in bounded_groups(packed.toLocalIterator(), lambda r: sum(len(c) for c in r), QUERY_BYTES):
        shared = spark.sparkContext.broadcast([r.asDict() for r in group])
        rows.select("id", "vector").mapInArrow(search_task(shared, k, scale), FOUND).write.mode("append").parquet(path)
        shared.unpersist()
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
