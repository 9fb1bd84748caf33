"""Predicates of the agreement search.

Each returns a Column, composed on the driver from the bound parameters: a parameter that is not given
adds no predicate, so what reaches the scan is plain column-to-literal tests.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.functions import dates
from pactlens.functions.conditional import nvl
from pactlens.functions.text import contains_ignoring_case, like_literal, overlaps_text, parse_list, split_list
from pactlens.schemas import PRODUCT_LOYALTY_BONUS

NO_ROWS = False


def equals(column: Column, value) -> Column:
    return column == F.lit(value)


def optional_strict(column: Column, value) -> Column:
    """column = NVL(value, column): without a value only NULLs go."""
    return column.isNotNull() if value is None else column == F.lit(value)


def optional_keep_null(column: Column, value, sentinel: str = "##") -> Column | None:
    """NVL(column, s) = NVL(value, NVL(column, s)): without a value all rows stay."""
    if value is None:
        return None
    if value == sentinel:
        return column.isNull() | (column == F.lit(value))
    return column == F.lit(value)


def optional_two_source(first: Column, second: Column, value, sentinel: str = "#") -> Column | None:
    """The optional test holds on either of two columns."""
    if value is None:
        return None
    return optional_keep_null(first, value, sentinel) | optional_keep_null(second, value, sentinel)


def in_list(column: Column, text: str | None) -> Column | None:
    """Column in a comma-separated parameter."""
    items = parse_list(text)
    return None if items is None else column.isin(items)


def not_equal(column: Column, value) -> Column:
    """A NULL is neither equal nor unequal, so it goes too."""
    return column != F.lit(value)


def name_contains(column: Column, text: str | None) -> Column:
    return contains_ignoring_case(column, text)


def name_contains_if_given(column: Column, text: str | None) -> Column | None:
    return like_literal(F.lower(column), text.lower()) if text else None


def created_between(column: Column, low: dt.date | None, high: dt.date | None) -> Column:
    return dates.day_between(column, low or dates.CREATED_FROM_DEFAULT, high or dates.CREATED_TO_DEFAULT)


def period_touches(valid_from: Column, valid_to: Column, low: dt.date | None, high: dt.date | None) -> Column:
    """Either end of the agreement lies in the range; one that spans the range is not found."""
    low, high = low or dates.PERIOD_FROM_DEFAULT, high or dates.PERIOD_TO_DEFAULT
    return dates.day_between(valid_to, low, high) | dates.day_between(valid_from, low, high)


def period_contained(valid_from: Column, valid_to: Column, low: dt.date | None, high: dt.date | None) -> Column:
    low, high = low or dates.PERIOD_FROM_DEFAULT, high or dates.PERIOD_TO_DEFAULT
    return dates.on_or_after(valid_from, low) & dates.on_or_before(valid_to, high)


def fiscal_year_as_calendar(valid_from: Column, valid_to: Column, low: dt.date | None, high: dt.date | None) -> Column:
    """A request for 1 April to 31 March finds agreements over the calendar year of its first day."""
    if low is None or high is None or (low.month, low.day, high.month, high.day) != (4, 1, 3, 31):
        return F.lit(NO_ROWS)
    first, last = dt.date(low.year, 1, 1), dt.date(low.year, 12, 31)
    return dates.day_between(valid_from, first, first) & dates.day_between(valid_to, last, last)


def period_matches(
    product: Column, valid_from: Column, valid_to: Column, low: dt.date | None, high: dt.date | None
) -> Column:
    touches = (product != PRODUCT_LOYALTY_BONUS) & period_touches(valid_from, valid_to, low, high)
    fiscal = (product == PRODUCT_LOYALTY_BONUS) & fiscal_year_as_calendar(valid_from, valid_to, low, high)
    return touches | period_contained(valid_from, valid_to, low, high) | fiscal


def pending_with(column: Column, text: str | None) -> Column | None:
    """'ALL' or nothing passes; else either text contains the other, or the column is a list item."""
    if text is None or text == "ALL":
        return None
    return overlaps_text(column, text) | column.isin(parse_list(text) or [])


def master_switch(master: Column, soto: str | None) -> Column:
    wanted = {"N": "Y", "Y": "N"}.get(soto or "N")
    return F.lit(NO_ROWS) if wanted is None else nvl(master, "Y") == wanted


def home_country_unless_soto(group_country: Column, header_country: Column, soto: str | None) -> Column | None:
    soto = soto or "N"
    if soto == "Y":
        return None
    return group_country == header_country if soto == "N" else F.lit(NO_ROWS)


def no_addendum_unless_soto(add_hdr_id: Column, soto: str | None) -> Column | None:
    soto = soto or "N"
    if soto == "Y":
        return None
    return add_hdr_id.isNull() if soto == "N" else F.lit(NO_ROWS)


def item_of(column: Column, text: str | None, default: Column) -> Column:
    """column in the list NVL(text, default)."""
    items = parse_list(text)
    if items is not None:
        return column.isin(items)
    if column is default:
        return column.isNotNull()
    return F.array_contains(split_list(default), column)


def soto_country(
    group_country: Column,
    header_country: Column,
    master: Column,
    soto: str | None,
    location_search: str | None,
    country: str | None,
    soto_countries: str | None,
) -> Column | None:
    """Country rule of sold-outside agreements. Without the indicator no row qualifies."""
    if soto == "N":
        return None
    if soto != "Y":
        return F.lit(NO_ROWS)
    in_group = item_of(group_country, soto_countries, group_country) & (master == "N")
    if location_search == "Y":
        return in_group
    if location_search == "N":
        return in_group & item_of(header_country, country, header_country)
    return F.lit(NO_ROWS)


def requested_by(created_by: Column, flag: str | None, user_name: str | None) -> Column | None:
    if flag is None:
        return None
    return created_by == user_name if flag == "Y" and user_name is not None else F.lit(NO_ROWS)


def all_of(*tests: Column | None) -> Column:
    """Conjunction of the tests that apply."""
    result = F.lit(True)
    for test in tests:
        if test is not None:
            result = result & test
    return result
