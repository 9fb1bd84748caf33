"""Exact-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wide enough for any amount, narrow enough that a quotient of two keeps 14 decimals.
MONEY = "decimal(24,8)"


def money(column: Column) -> Column:
    return column.cast(MONEY)


def round_half_away(column: Column, places: int) -> Column:
    """Decimal rounding, half away from zero."""
    return F.round(column, places)


def quotient(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    divisor = money(denominator)
    return F.when(divisor != 0, money(numerator) / divisor)


def percent(numerator: Column, denominator: Column, places: int = 3) -> Column:
    return round_half_away(quotient(numerator, denominator) * F.lit(100), places)
