"""Schemas and column names shared by readers and operators."""

from pyspark.sql import types as T

# The 22 columns of an incident file, in file order.
INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("Case Number", T.StringType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Block", T.StringType()),
        T.StructField("IUCR", T.StringType()),
        T.StructField("Primary Type", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Location Description", T.StringType()),
        T.StructField("Arrest", T.StringType()),
        T.StructField("Domestic", T.StringType()),
        T.StructField("Beat", T.StringType()),
        T.StructField("District", T.StringType()),
        T.StructField("Ward", T.StringType()),
        T.StructField("Community Area", T.StringType()),
        T.StructField("FBI Code", T.StringType()),
        T.StructField("X Coordinate", T.DoubleType()),
        T.StructField("Y Coordinate", T.DoubleType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Updated On", T.StringType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Location", T.StringType()),
    ]
)

# The columns of cleaned incidents, in order.
CLEAN_COLUMNS = ["Timestamp", "Latitude", "Longitude", "Primary Type", "Year", "Week"]

CORRUPT = "_corrupt_record"

# Numeric columns that may hold text in an untyped file.
COORDINATES = ["X Coordinate", "Y Coordinate", "Latitude", "Longitude"]


def lenient_schema() -> T.StructType:
    """The incident schema with coordinates as text, for files that need coercion."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name in COORDINATES else f.dataType)
            for f in INCIDENT_SCHEMA
        ]
    )


# Defaults of the two hotspot methods and the forecast models.
CELL_SIZE = 0.001
HOT_QUANTILE = 0.95
NEIGHBOURS = 64
SMOOTHING = 5000
OMEGA = -0.27
EPS = 500.0
MIN_POINTS = 60
SEASON_GRID = 52
SEASON_CLUSTER = 4
MIN_WEEKS_CLUSTER = 20
DEFAULT_WINDOW_WEEKS = 4
ID_MODULUS = 100000
