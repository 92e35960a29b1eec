"""Helpers shared by the operators: Arrow passes, checked broadcasts and text columns."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweek.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, salted_join, stored_bytes
from cellweek.sources.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text that one Python step holds at a time.
STEP_BYTES = 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def text_column(name: str) -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, empty for null."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def text_bytes(column: pa.Array) -> list[int]:
    """The lengths of the UTF-8 bytes of a string column, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def slices(sizes: list[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most `most` in total, or of one larger item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def bounded_groups(rows: Iterable, size: Callable, most: int) -> Iterator[list]:
    """Consecutive rows in groups of at most `most` in total size, or of one larger row."""
    group, total = [], 0
    for row in rows:
        n = size(row)
        if group and total + n > most:
            yield group
            group, total = [], 0
        group.append(row)
        total += n
    if group:
        yield group


def free_name(columns: list[str], base: str) -> str:
    """A column name that differs from all given ones, as Spark compares them."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def add_columns(
    docs: DataFrame, text: str, fields: list[T.StructField], make: Callable[[list[bytes]], list[list]], keep: list[str]
) -> DataFrame:
    """The kept columns with new ones, computed in Arrow batches from the text.

    make gets the UTF-8 texts (null: empty) of some rows and returns one list per new field. A
    kept column with the name of a new field is replaced.
    """
    new = {f.name for f in fields}
    names = [c for c in keep if c not in new]
    source = docs.select(*names, text_column(text).alias(free_name(names, "_text")))
    schema = T.StructType([*docs.select(*names).schema.fields, *fields])
    kinds = [T.StructType([f]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [to_arrow_schema(k).field(0).type for k in kinds]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(text_bytes(texts)):
                made = [pa.array(v, type=t) for v, t in zip(make(utf8(texts.slice(a, b - a))), types, strict=True)]
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is within the limits for a broadcast."""
    return stored_bytes(table) <= size and table.count() <= rows


def without_ids(docs: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in a stored table of unique keys; rows with a null key stay."""
    hits = F.broadcast(drop) if is_small(drop) else drop
    return docs.join(hits.select(key), key, "left_anti").select(*docs.columns)


__all__ = ["add_columns", "ascii_lower", "bounded_groups", "free_name", "is_small", "materialize", "read_table", "salted_join", "slices", "text_bytes", "text_column", "utf8", "without_ids"]
