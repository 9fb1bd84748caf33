"""Currency conversion: the latest rate on or before a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate_months(rates: DataFrame, target_currency: str) -> DataFrame:
    """Validity intervals of the rates into `target_currency`, one row per month each one touches.

    The open interval of a currency ends in the last month any rate starts in; later dates are looked
    up in that month. Rows: one per rate plus one per currency and month of the rate history.
    """
    wanted = rates.where(F.col("target_currency") == target_currency)
    history = W.partitionBy("currency").orderBy("valid_from")
    intervals = wanted.withColumn("valid_until", F.lead("valid_from").over(history))
    horizon = wanted.agg(F.max("valid_from")).scalar()
    last_month = F.coalesce(F.col("valid_until"), horizon)
    months = F.sequence(F.trunc("valid_from", "MM"), F.trunc(last_month, "MM"), F.expr("interval 1 month"))
    return intervals.select(
        F.col("currency").alias("fx_currency"), "valid_from", "valid_until", "rate", F.explode(months).alias("fx_month")
    )


def with_rate(df: DataFrame, rates: DataFrame, currency: Column, on: Column, target_currency: str, name: str = "fx_rate") -> DataFrame:
    """Add the rate from `currency` into the target on the given date; NULL before the first rate.

    An equi-join on (currency, month) with a range test inside the month: Spark broadcasts the months
    when they are small and shuffles (and splits a hot currency-month) when not.
    """
    months = rate_months(rates, target_currency)
    horizon = rates.where(F.col("target_currency") == target_currency).agg(F.max("valid_from")).scalar()
    keyed = (
        df.withColumn("fx_from", currency)
        .withColumn("fx_on", on)
        .withColumn("fx_key_month", F.least(F.trunc("fx_on", "MM"), F.trunc(horizon, "MM")))
    )
    joined = keyed.join(
        months,
        (F.col("fx_from") == F.col("fx_currency"))
        & (F.col("fx_key_month") == F.col("fx_month"))
        & (F.col("fx_on") >= F.col("valid_from"))
        & (F.col("valid_until").isNull() | (F.col("fx_on") < F.col("valid_until"))),
        "left",
    )
    same = F.col("fx_from") == target_currency
    return joined.withColumn(name, F.when(same, F.lit(1).cast("decimal(9,3)")).otherwise(F.col("rate"))).drop(
        "fx_from", "fx_on", "fx_key_month", "fx_currency", "fx_month", "valid_from", "valid_until", "rate"
    )
