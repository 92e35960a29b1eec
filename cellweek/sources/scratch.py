"""Scratch tables: cut lineage by writing to the shared folder and reading back.

A written table survives the loss of executors, is pruned and filtered like any Parquet
input, and carries a real size for the planner.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cellweek-")
    spark.conf.set(_SETTING, folder)
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/cellweek-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df once and return a reader of the result."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
