"""Conditional expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def nvl(*values) -> Column:
    return F.coalesce(*[_column(value) for value in values])


def first_match(cases: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """Searched CASE: the first true test wins, a NULL test does not match."""
    (test, value), *rest = cases
    chain = F.when(test, _column(value))
    for test, value in rest:
        chain = chain.when(test, _column(value))
    return chain.otherwise(_column(otherwise))


def decode(column: Column, pairs: Mapping[object, object], otherwise=None) -> Column:
    """NULL-safe lookup: a None key matches NULL."""
    return first_match([(column.eqNullSafe(F.lit(key)), value) for key, value in pairs.items()], otherwise)


def label(column: Column, labels: Mapping[str, str]) -> Column:
    """Known codes get their label, others stay as they are."""
    return first_match([(column == key, value) for key, value in labels.items()], column)


def yes_no(test: Column) -> Column:
    return F.when(test, F.lit("Y")).otherwise(F.lit("N"))
