"""CSV to Parquet.

spark-submit cellweek/plans/convert.py <input csv> <output parquet> [partition column ...]
"""

import sys

from pyspark.sql import SparkSession

from cellweek.plans.session import job_session
from cellweek.sources.incidents import read_incident_csv, replace_partitions, write_table


def convert(spark: SparkSession, source: str, target: str, partition_by: list[str] | None = None) -> None:
    """Rewrite incidents as Parquet; partitioning by Year lets later scans skip files.

    Partitions that occur in the file are replaced and all others stay, so a table can be renewed
    year by year. Without partitions the whole table is replaced.
    """
    raw = read_incident_csv(spark, source)
    if partition_by:
        replace_partitions(raw, target, partition_by)
    else:
        write_table(raw, target)


if __name__ == "__main__":
    if len(sys.argv) < 3:
        sys.exit("usage: convert.py <input csv> <output parquet> [partition column ...]")
    convert(job_session("cellweek-convert"), sys.argv[1], sys.argv[2], sys.argv[3:] or None)
