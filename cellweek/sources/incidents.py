"""Incident files, derived tables and their sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweek.schema import CORRUPT, INCIDENT_SCHEMA, lenient_schema
from cellweek.sources.publish import current_path, publish

# Models in one row group of the model table.
MODEL_ROWS = 10_000


def read_incident_csv(
    spark: SparkSession, path: str, keep_corrupt: bool = False, lenient: bool = False
) -> DataFrame:
    """CSV with a header in the fixed schema; bad cells become NULL.

    keep_corrupt adds the text of malformed rows; lenient keeps coordinates as text for
    the projected-coordinate cleaning, which coerces them itself.
    """
    schema = lenient_schema() if lenient else INCIDENT_SCHEMA
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        # Without pruning a row of the wrong length is marked whatever columns are used. A cell
        # of the wrong type marks its row when its column is read.
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    return reader.schema(schema).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table or published result. A given schema saves the footer read that inference needs."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current_path(spark, path))


def of_years(incidents: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """The incidents of some years; of a table that is partitioned by Year only those folders are read."""
    if first is not None:
        incidents = incidents.where(F.col("Year") >= first)
    return incidents if last is None else incidents.where(F.col("Year") <= last)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table. The rebalance hint lets Spark choose even file sizes."""
    writer = df.hint("rebalance").write.mode("overwrite")
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that occur in df and leave all others of the table as they are."""
    even = df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    even.partitionBy(*partition_by).parquet(path)


def publish_table(df: DataFrame, path: str) -> None:
    """Replace a Parquet result; readers see the old one until the new one is complete."""
    publish(df.sparkSession, path, lambda folder: write_table(df, folder))


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV file set with a header row."""
    df.write.mode("overwrite").csv(path, header=True)


def publish_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV result; readers see the old one until the new one is complete."""
    publish(df.sparkSession, path, lambda folder: write_csv(df, folder))


def publish_models(models: DataFrame, path: str, keys: list[str], ids: tuple = ("hotspot_id_combined",), rows: int = MODEL_ROWS) -> None:
    """Replace the model table so that a lookup reads few rows.

    Files are ranges of the keys, sorted, in row groups of a bounded number of rows: their
    statistics lead a lookup by key to one group. Bloom filters of the keys and of the short ids
    let the other groups be skipped where the statistics cannot tell.
    """
    blooms = [*keys, *(c for c in ids if c in models.columns)]
    writer = models.repartitionByRange(*keys).sortWithinPartitions(*keys).write
    writer = writer.option("parquet.block.row.count.limit", rows).option("parquet.page.row.count.limit", rows)
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", rows)
    publish(models.sparkSession, path, writer.parquet)


def model_for(models: DataFrame, x: int, y: int) -> DataFrame:
    """Fitted parameters of one cell; the filter reaches the Parquet scan."""
    return models.where((F.col("hotspot_id_x") == x) & (F.col("hotspot_id_y") == y))


def models_with_id(models: DataFrame, combined: int) -> DataFrame:
    """Fitted parameters by short id. Several rows mean that ids collide."""
    return models.where(F.col("hotspot_id_combined") == combined)
