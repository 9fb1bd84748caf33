"""Global rank by date and pages cut from it, without one global sort.

RANK() over all rows needs no order among the rows themselves, only the number of rows with a later
date. So rows are counted per date (map-side combined), the counts are accumulated from the newest
date down in bounded steps (days, seconds within a day, values within a second), and the rank goes
back to the rows by a join on the date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.session import materialize

HOT_SHARE = 1000


def rank_of_values(df: DataFrame, column: str) -> DataFrame:
    """One row per distinct date: `rank_key`, `rank_rows` (rows having it) and `rnk`, newest and NULL first.

    The counts are written once: the steps below read that small table, so `df` is evaluated a single time.
    """
    counts = materialize(df.groupBy(F.col(column).alias("rank_key")).agg(F.count(F.lit(1)).alias("rank_rows")), "date-counts")
    if isinstance(df.schema[column].dataType, T.TimestampType):
        # By instant: around a clock change the local time of day goes back.
        second = F.expr("unix_micros(rank_key) div 1000000")
        counts = counts.withColumn("rank_day", F.expr("unix_micros(rank_key) div 86400000000")).withColumn("rank_second", second)
    else:
        counts = counts.withColumn("rank_day", F.to_date("rank_key")).withColumn("rank_second", F.date_format("rank_key", "HH:mm:ss"))
    seconds = counts.groupBy("rank_day", "rank_second").agg(F.sum("rank_rows").alias("n"))
    days = seconds.groupBy("rank_day").agg(F.sum("n").alias("n"))

    def rows_before(window) -> Column:
        window = window.rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    # At most one row per calendar day passes through this unpartitioned window.
    days = days.select(
        F.col("rank_day").alias("d_day"),
        rows_before(W.orderBy(F.desc_nulls_first("rank_day"))).alias("d_before"),
    )
    seconds = seconds.select(
        F.col("rank_day").alias("s_day"),
        F.col("rank_second").alias("s_second"),
        rows_before(W.partitionBy("rank_day").orderBy(F.desc_nulls_first("rank_second"))).alias("s_before"),
    )
    in_second = W.partitionBy("rank_day", "rank_second").orderBy(F.desc_nulls_first("rank_key"))
    values = counts.withColumn("n", F.col("rank_rows")).withColumn("v_before", rows_before(in_second))
    return (
        values.join(
            seconds,
            F.col("rank_day").eqNullSafe(F.col("s_day")) & F.col("rank_second").eqNullSafe(F.col("s_second")),
        )
        .join(days, F.col("rank_day").eqNullSafe(F.col("d_day")))
        .select("rank_key", "rank_rows", (F.lit(1) + F.col("d_before") + F.col("s_before") + F.col("v_before")).alias("rnk"))
    )


def with_rank(df: DataFrame, column: str, name: str = "rnk") -> DataFrame:
    """All rows with their rank.

    Dates that hold more than a thousandth of all rows (so fewer than a thousand dates) get their rank
    by broadcast; those rows then spread over the partitions of the second join, which ranks the rest.
    """
    ranks = materialize(rank_of_values(df, column), "date-ranks")
    total = ranks.agg(F.sum("rank_rows")).scalar()
    is_hot = F.col("rank_rows") * HOT_SHARE > total
    hot = ranks.where(is_hot).select(F.col("rank_key").alias("hot_key"), F.col("rnk").alias("hot_rank"))
    # Always -1, but not a literal: a constant would be folded out of the join keys.
    no_salt = F.pmod(F.xxhash64("rank_key"), F.lit(1)).cast("int") - 1
    cold = ranks.where(~is_hot).select(
        F.col("rank_key").alias("cold_key"), no_salt.alias("cold_salt"), F.col("rnk").alias("cold_rank")
    )
    marked = df.join(F.broadcast(hot), F.col(column).eqNullSafe(F.col("hot_key")), "left")
    ranked = F.col("hot_rank").isNotNull()
    salt = F.when(ranked, F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("int")).otherwise(F.lit(-1))
    marked = marked.withColumn("rank_join", F.when(~ranked, F.col(column))).withColumn("rank_salt", salt)
    joined = marked.join(
        cold,
        (F.col("rank_salt") == F.col("cold_salt")) & F.col("rank_join").eqNullSafe(F.col("cold_key")),
        "left",
    )
    return joined.withColumn(name, F.coalesce("hot_rank", "cold_rank")).drop(
        "hot_key", "hot_rank", "cold_key", "cold_salt", "cold_rank", "rank_join", "rank_salt"
    )


def page_of(rank: Column, number: int, size: int) -> Column:
    """Rank in ((number-1)*size, number*size]; ties can make a page longer than `size`."""
    return (rank > (number - 1) * size) & (rank <= number * size)


def page_by_rank(df: DataFrame, column: str, number: int, size: int, name: str = "rnk") -> DataFrame:
    """Rows of one page. Its dates number at most `size`, since each holds a row."""
    dates = rank_of_values(df, column).where(page_of(F.col("rnk"), number, size)).select("rank_key", F.col("rnk").alias(name))
    return df.join(dates, F.col(column).eqNullSafe(F.col("rank_key"))).drop("rank_key")
