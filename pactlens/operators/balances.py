"""Balances kept up as rows arrive: sums per deal, membership and expiry date, stored by month of expiry.

A batch is summed alone, combined on the map side, and only the months that it touches are read, merged and replaced. Sums
add up, so the state equals one grouping over all rows ever added, in any order of the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.session import materialize

KEYS = ("track_code", "membership_no", "miles_expiry_date")
AMOUNTS = ("miles_earned", "miles_redeemed", "miles_balance", "miles_expiry")
MONTH = "expiry_month"
NO_MONTH = "none"  # of rows without a date


def _sums(rows: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("miles_expiry_date", "yyyy-MM"), F.lit(NO_MONTH))
    # One type for a batch's sums and for the sums of sums.
    return rows.groupBy(*KEYS).agg(*[F.sum(name).cast("decimal(28,4)").alias(name) for name in AMOUNTS]).withColumn(MONTH, month)


def start_balances(rows: DataFrame, path: str) -> None:
    """The state of a first set of rows."""
    _sums(rows).write.partitionBy(MONTH).parquet(path)


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_state_schema()).parquet(path).drop(MONTH)


def _state_schema() -> str:
    amounts = ", ".join(f"{name} decimal(28,4)" for name in AMOUNTS)
    return f"track_code string, membership_no string, miles_expiry_date date, {amounts}, {MONTH} string"


def add_balances(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """Adds a batch of rows to the state; returns the months that were replaced, all others keep their files."""
    batch = materialize(_sums(rows), "balance-batch")
    months = sorted(row[0] for row in batch.select(MONTH).distinct().collect())  # months of a calendar, however many rows
    if months:
        state = spark.read.schema(_state_schema()).parquet(path).where(F.col(MONTH).isin(months))
        merged = _sums(state.drop(MONTH).unionByName(batch.drop(MONTH)))
        # Written aside first: its own input is replaced.
        merged = materialize(merged, "balance-months")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return months
