"""Text expressions. NULL counts as empty text when joined; an empty text is stored as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty_as_null(df: DataFrame) -> DataFrame:
    """Store '' as NULL in every text column. Run at ingest: over a scan it would block filter pushdown."""
    return df.select(
        *[
            F.nullif(F.col(f"`{field.name}`"), F.lit("")).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )


def join_text(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(part.cast("string"), F.lit("")) for part in parts])


def full_name(first: Column, last: Column) -> Column:
    """First and last name; the blank between them stays when either is missing."""
    return join_text(first, F.lit(" "), last)


def like_literal(column: Column, text: str) -> Column:
    """`column LIKE %text%` where % and _ in `text` stay wildcards and a backslash is an ordinary character."""
    if "%" in text or "_" in text:
        return column.like("%" + text.replace("\\", "\\\\") + "%")
    return column.contains(text)


def contains_ignoring_case(column: Column, text: str | None) -> Column:
    """Case-blind contains; no text matches every non-NULL value."""
    if not text:
        return column.isNotNull()
    return like_literal(F.upper(column), text.upper())


def overlaps_text(column: Column, text: str) -> Column:
    """The column contains the text, or the text contains the column."""
    return (F.instr(column, text) > 0) | F.lit(text).contains(column)


def parse_list(text: str | None) -> list[str] | None:
    """Items of a comma-separated parameter; None when there is no parameter."""
    if not text:
        return None
    return [item.strip() for item in text.split(",") if item.strip()]


def split_list(column: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(column, ","), lambda item: F.trim(item)), lambda item: item != "")
