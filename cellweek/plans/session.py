"""Session of a submitted job; master and resources come from spark-submit."""

from pyspark.sql import SparkSession


def job_session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
