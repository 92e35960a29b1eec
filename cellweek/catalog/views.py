"""Incident and point tables derived from the test tables, as DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders placed at the centre of a grid cell that depends on their customer."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    size, half = F.lit(0.001), F.lit(0.0005)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        "o_orderdate",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        "c_mktsegment",
        (F.lit(-87.9) + F.col("c_nationkey") * size + half).alias("lon"),
        (F.lit(41.6) + F.floor(F.col("c_acctbal") / 1000) * size + half).alias("lat"),
    )


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    return placed_orders(spark, folder).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("Timestamp"),
        F.col("lat").alias("Latitude"),
        F.col("lon").alias("Longitude"),
        F.col("o_orderpriority").alias("Primary Type"),
    )


def raw_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The 22 raw columns, with missing, unparsable and one-digit dates, and bad coordinates."""
    placed = placed_orders(spark, folder)
    seconds = (F.floor(F.col("o_totalprice") * 100) % 86400).cast("int")
    ts = F.date_trunc("day", "o_orderdate") + F.make_dt_interval(secs=seconds)
    price = F.col("o_totalprice")
    date = (
        F.when(price < 6000, F.lit(None))
        .when(price < 12000, F.lit("unknown"))
        .when(price < 60000, F.date_format(ts, "M/d/yyyy h:mm:ss a"))
        .otherwise(F.date_format(ts, "MM/dd/yyyy hh:mm:ss a"))
    )
    lat = (
        F.when(price > 497000, F.lit(None))
        .when(price > 494000, F.lit(0.0))
        .when(price.between(300000, 310000), F.lit(float("nan")))
        .otherwise(F.col("lat"))
    )
    lon = F.when(price.between(490000, 494000), F.lit(0.0)).otherwise(F.col("lon"))
    text = {
        "Case Number": F.concat(F.lit("C"), F.col("o_orderkey").cast("string")),
        "Block": F.col("c_mktsegment"),
        "IUCR": F.col("o_orderstatus"),
        "Primary Type": F.col("o_orderpriority"),
        "Description": F.col("o_orderpriority"),
        "Location Description": F.col("c_mktsegment"),
        "Arrest": F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"),
        "Domestic": F.when(F.col("o_orderstatus") == "P", "true").otherwise("false"),
        "Beat": F.lit(None).cast("string"),
        "District": F.lit("1"),
        "Ward": F.lit("2"),
        "Community Area": F.lit("3"),
        "FBI Code": F.col("o_orderstatus"),
    }
    return placed.select(
        F.col("o_orderkey").cast("int").alias("ID"),
        text["Case Number"].alias("Case Number"),
        date.alias("Date"),
        *[c.alias(n) for n, c in text.items() if n != "Case Number"],
        F.when(price.between(486000, 490000), F.lit(None)).otherwise(F.floor(price)).cast("double").alias("X Coordinate"),
        F.floor("o_totalprice").cast("double").alias("Y Coordinate"),
        F.year("o_orderdate").alias("Year"),
        F.lit(None).cast("string").alias("Updated On"),
        lat.alias("Latitude"),
        lon.alias("Longitude"),
        F.concat(F.lit("("), F.col("c_mktsegment"), F.lit(", "), F.col("o_orderstatus"), F.lit(")")).alias("Location"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a point: its value against the number in its properties."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One forecast request per customer for its own cell, with all kinds of windows."""
    balance = F.col("c_acctbal")
    start = F.date_add(F.lit("2001-06-01").cast("date"), (balance / 40).cast("int"))
    end = F.date_add(start, (F.col("c_nationkey") * 4 - 8).cast("int"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.floor(
            (F.lit(-87.9) + F.col("c_nationkey") * F.lit(0.001) + F.lit(0.0005)) / F.lit(0.001)
        ).alias("hotspot_id_x"),
        F.floor(
            (F.lit(41.6) + F.floor(balance / 1000) * F.lit(0.001) + F.lit(0.0005)) / F.lit(0.001)
        ).alias("hotspot_id_y"),
        F.when(F.col("c_mktsegment") != "MACHINERY", start).alias("start_date"),
        F.when(F.col("c_mktsegment") != "BUILDING", end).alias("end_date"),
    )
