"""Date expressions. Day tests are written as half-open ranges on the raw column so that scans can prune."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds that stand in for a missing date parameter.
CREATED_FROM_DEFAULT = dt.date(2000, 1, 1)
CREATED_TO_DEFAULT = dt.date(2099, 12, 31)
PERIOD_FROM_DEFAULT = dt.date(2000, 1, 1)
PERIOD_TO_DEFAULT = dt.date(9999, 12, 31)


def truncate_day(column: Column) -> Column:
    return F.to_date(column)


def as_date(value: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(value, str):
        return dt.date.fromisoformat(value[:10])
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def _midnight(day: dt.date) -> Column:
    return F.lit(day.isoformat() + " 00:00:00").cast("timestamp_ntz")


def on_or_after(column: Column, day: dt.date) -> Column:
    return column >= _midnight(day)


def on_or_before(column: Column, day: dt.date) -> Column:
    if day == dt.date.max:
        return column.isNotNull()
    return column < _midnight(day + dt.timedelta(days=1))


def day_between(column: Column, low: dt.date, high: dt.date) -> Column:
    """trunc(column) between low and high."""
    return on_or_after(column, low) & on_or_before(column, high)


def within_bounds(column: Column, times: DataFrame, name: str) -> Column:
    """The column lies between the least and the greatest time of a frame; false when it has none.

    The two bounds pass through the driver in a form free of time zones and end up as literals that a
    scan can prune by.
    """
    kind = times.schema[name].dataType
    zoned = isinstance(kind, T.TimestampType)

    def as_plain(bound: Column) -> Column:
        return F.unix_micros(bound) if zoned else bound.cast("string")

    def as_literal(value) -> Column:
        return F.timestamp_micros(F.lit(value)) if zoned else F.lit(value).cast(kind)

    first, last = times.agg(as_plain(F.min(name)), as_plain(F.max(name))).first()
    return F.lit(False) if first is None else column.between(as_literal(first), as_literal(last))


def day_and_month(column: Column) -> Column:
    return F.date_format(column, "ddMM")


def year_text(column: Column) -> Column:
    return F.date_format(column, "yyyy")


def date_from_text(column: Column, pattern: str = "dd-MM-yyyy") -> Column:
    return F.to_date(column, pattern)


def sentinel_as_null(column: Column) -> Column:
    """Year-1 dates mean "not set"."""
    return F.when(F.year(column) > 1, column)
