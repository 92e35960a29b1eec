"""Cleaning of raw incidents, in the geographic and the projected-coordinate variant."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cellweek.functions.holidays import is_holiday
from cellweek.functions.scalars import parse_timestamp, to_number
from cellweek.schema import CLEAN_COLUMNS, COORDINATES


def date_features(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Year, Month, ISO Week and DayOfWeek (1 = Sunday); an existing Year is replaced."""
    return df.withColumns(
        {
            "Year": F.year(ts),
            "Month": F.month(ts),
            "Week": F.weekofyear(ts),
            "DayOfWeek": F.dayofweek(ts),
        }
    )


def clean_incidents(raw: DataFrame) -> DataFrame:
    """Rows with a usable time and non-zero coordinates, reduced to the analysis columns.

    The NULL and zero tests are plain column predicates, so they reach the Parquet scan.
    """
    kept = raw.dropna(subset=["Latitude", "Longitude", "Date"]).where(
        (F.col("Latitude") != 0) & (F.col("Longitude") != 0)
    )
    parsed = kept.withColumn("Timestamp", parse_timestamp("Date")).dropna(subset=["Timestamp"])
    dated = parsed.withColumns({"Year": F.year("Timestamp"), "Week": F.weekofyear("Timestamp")})
    return dated.select(*CLEAN_COLUMNS)


def write_counted(raw: DataFrame, cleaning, path: str) -> DataFrame:
    """Writes the cleaned rows as Parquet; raw_rows and clean_rows in one row.

    Both counts are observed while the rows pass, so the table is scanned once and no rule is
    stated twice.
    """
    before, after = Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    cleaning(raw.observe(before, one)).observe(after, one).write.mode("overwrite").parquet(path)
    # The plan of an empty input can lose its observations.
    counts = [(o.get or {}).get("n", 0) for o in (before, after)]
    return raw.sparkSession.createDataFrame([tuple(counts)], "raw_rows long, clean_rows long")


def clean_projected(raw: DataFrame) -> DataFrame:
    """All columns, with Date parsed, coordinates coerced to numbers and holidays flagged.

    Zero coordinates stay; rows without any of the four coordinates or a time are dropped.
    """
    coerced = raw.withColumns(
        {"Date": parse_timestamp("Date")}
        | {c: to_number(F.col(c).cast("string")) for c in COORDINATES}
    )
    return coerced.dropna(subset=["Date"] + COORDINATES).withColumn("is_holiday", is_holiday("Date"))


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
