"""The clock: every operator takes `as_of` instead of asking for the current time."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def stamp(as_of: datetime, data_type: DataType | str) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast(data_type)


def moment(as_of: datetime, df: DataFrame, column: str) -> Column:
    """`as_of` as a literal of the column's own type.

    Tables may hold `timestamp` or `timestamp_ntz`; a literal of the other type
    would make every comparison depend on the session zone.
    """
    return stamp(as_of, df.schema[column].dataType)


def plus_days(start: Column, days: Column) -> Column:
    """Calendar days after `start`; NULL when either is NULL."""
    zero = F.lit(0)
    return start + F.make_interval(zero, zero, zero, days.cast("int"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days from `earlier` to `later`, truncated toward zero."""
    return F.extract(F.lit("day"), later - earlier).cast("bigint")


def on_day(ts: Column, as_of: datetime) -> Column:
    return F.to_date(ts) == F.lit(as_of.date())
