"""Aggregations over child tables.

All of them combine on the map side (sums, counts, max/min of a struct), so a parent with a third of all
children costs one small partial row per task. Ordered lists cannot combine so; where a parent has very many
entries they are made in chunks: ranges of (parent, order) over all tasks, a text per chunk, and the chunk
texts joined in order. The result is one text per parent by definition; no length is refused or cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 20_000  # of a parent whose list one task makes at once


def list_column(value: Column, order: Sequence[Column], separator: str) -> Column:
    """Non-NULL values joined by `separator` in the given order; NULL when there are none.

    A NULL order key sorts last. The order should be total, else equal keys fall back to the value.
    """
    text = value.cast("string")
    keys = [part for key in order for part in (key.isNull(), key)]
    entry = F.struct(*[part.alias(f"k{n}") for n, part in enumerate(keys)], text.alias("v"))
    entries = F.array_sort(F.collect_list(F.when(text.isNotNull(), entry)))
    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda item: item["v"]), separator))


def ordered_lists(
    df: DataFrame,
    keys: Sequence[str],
    lists: dict[str, tuple[Column, Sequence[Column], str]],
    also: dict[str, Column] | None = None,
    most: int = MOST_ENTRIES,
) -> DataFrame:
    """Several ordered lists per key: name -> (value, order, separator); `also` adds plain aggregates.

    A count, combined on the map side, tells whether any parent has more than `most` entries. If none has, one grouping
    makes all lists; else they are made in chunks. Both give the same texts.
    """
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") > most)
    if not heavy.isEmpty():
        return chunked_lists(df, keys, lists, also)
    columns = [list_column(*spec).alias(name) for name, spec in lists.items()]
    columns += [aggregate.alias(name) for name, aggregate in (also or {}).items()]
    return df.groupBy(*keys).agg(*columns)


def chunked_lists(
    df: DataFrame, keys: Sequence[str], lists: dict[str, tuple[Column, Sequence[Column], str]], also: dict[str, Column] | None = None
) -> DataFrame:
    """The same lists, without a task that holds all entries of a parent.

    Entries are range-partitioned by parent and order keys. A task makes the texts of its stretch of each parent; a parent's
    last step sees one row per stretch. Lists in different orders are made one after the other and joined by parent.
    Entries that share all order keys stay together; where a call makes a single list its value is an order key as well.
    """
    by_order: dict[str, dict] = {}
    for name, spec in lists.items():
        by_order.setdefault(str(list(spec[1])), {})[name] = spec
    parts = [_chunked(df, keys, some) for some in by_order.values()]
    if also:
        parts.append(df.groupBy(*keys).agg(*[aggregate.alias(name) for name, aggregate in also.items()]))
    result = parts[0]
    for part in parts[1:]:
        other = part.withColumnsRenamed({key: f"other_{key}" for key in keys})
        same = F.lit(True)
        for key in keys:
            same = same & result[key].eqNullSafe(other[f"other_{key}"])
        result = result.join(other, same).drop(*[f"other_{key}" for key in keys])
    return result.select(*keys, *lists, *(also or {}))


def _chunked(df: DataFrame, keys: Sequence[str], lists: dict[str, tuple[Column, Sequence[Column], str]]) -> DataFrame:
    """Lists of one order."""
    specs = list(lists.items())
    order = list(specs[0][1][1])
    if len(specs) == 1:
        order.append(specs[0][1][0].cast("string"))
    names = [f"order_{n}" for n in range(len(order))]
    values = {f"value_{n}": value.cast("string") for n, (_, (value, _, _)) in enumerate(specs)}
    read = df.select(*keys, *[key.alias(name) for key, name in zip(order, names)], *[value.alias(name) for name, value in values.items()])
    ranged = read.repartitionByRange(*keys, *[F.col(name).asc_nulls_last() for name in names])
    stretch = ranged.groupBy(*keys, F.spark_partition_id().alias("stretch")).agg(
        *[list_column(F.col(value), [F.col(name) for name in names], separator).alias(value) for value, (_, (_, _, separator)) in zip(values, specs)]
    )
    texts = F.array_sort(F.collect_list(F.struct("stretch", *values)))  # a row per stretch

    def joined(value: str, separator: str) -> Column:
        held = F.filter(F.transform("texts", lambda item: item[value]), lambda text: text.isNotNull())
        return F.when(F.size(held) > 0, F.array_join(held, separator))

    whole = stretch.groupBy(*keys).agg(texts.alias("texts"))
    return whole.select(*keys, *[joined(value, separator).alias(name) for value, (name, (_, _, separator)) in zip(values, specs)])


def latest(value: Column, order: Column) -> Column:
    """Value of the row with the greatest order key (descending top-1 as an aggregate)."""
    return F.max(F.when(order.isNotNull(), F.struct(order.alias("k"), value.alias("v"))))["v"]


def lowest(value: Column, *order: Column) -> Column:
    """Value of the row with the lowest order keys: a stated choice where any row would do."""
    keys = [key.alias(f"k{n}") for n, key in enumerate(order)]
    return F.min(F.struct(*keys, value.alias("v")))["v"]


def with_flag(df: DataFrame, matches: DataFrame, key: str, name: str, present: str = "Y", absent: str = "N") -> DataFrame:
    """Flag per row whether its key occurs in `matches`."""
    keys = matches.select(F.col(key).alias("flag_key")).distinct()
    flag = F.when(F.col("flag_key").isNotNull(), present).otherwise(absent)
    return df.join(keys, df[key] == F.col("flag_key"), "left").withColumn(name, flag).drop("flag_key")
