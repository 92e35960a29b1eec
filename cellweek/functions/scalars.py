"""Scalar column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweek.schema import CELL_SIZE, ID_MODULUS

# Accepts one- and two-digit months, days and hours; anything else becomes NULL.
DATE_PATTERN = "M/d/yyyy h:mm:ss a"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(text) -> Column:
    """Timestamp of a 12-hour US date string, NULL when it does not parse."""
    return F.try_to_timestamp(_col(text), F.lit(DATE_PATTERN))


def to_number(text) -> Column:
    """Double value of a text column, NULL when it is not a number.

    Spark's cast takes the type suffixes d and f of a literal; here they are no number.
    """
    typed = F.trim(_col(text)).rlike("[0-9.][dDfF]$")
    return F.when(~typed, _col(text).try_cast("double"))


def week_end(ts) -> Column:
    """Sunday that closes the Monday-to-Sunday week of a date or timestamp."""
    day = F.to_date(_col(ts))
    return F.date_add(day, 6 - F.weekday(day))


def weeks_between(later, earlier) -> Column:
    """Whole weeks from the week of one date to the week of another."""
    return (F.datediff(week_end(later), week_end(earlier)) / 7).cast("bigint")


def iso_day(day) -> Column:
    return F.date_format(_col(day), "yyyy-MM-dd")


def cell_index(coordinate, size: float = CELL_SIZE) -> Column:
    """Grid index of a coordinate; negative coordinates floor downwards."""
    return F.floor(_col(coordinate) / F.lit(float(size)))


def cell_centre(index, size: float = CELL_SIZE) -> Column:
    return (_col(index) + F.lit(0.5)) * F.lit(float(size))


def combined_id(x, y) -> Column:
    """Short id of a cell. Ids can collide, so joins use the two indexes instead."""
    key = F.concat(_col(x).cast("string"), F.lit("_"), _col(y).cast("string"))
    return F.abs(F.hash(key).cast("bigint")) % F.lit(ID_MODULUS)


def round_cents(value) -> Column:
    """Two decimals, halves to even, computed on the double as NumPy does."""
    return F.rint(_col(value) * 100) / 100


def marker_radius(count) -> Column:
    return F.sqrt(_col(count).cast("double")) / 2
