"""The set of agreement tables a job reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from pactlens.functions.text import empty_as_null
from pactlens.schemas import TABLES


class AgreementTables:
    """Named DataFrames, loaded when first asked for: `tables.inc_hdr`."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame]):
        self.spark = spark
        self._load = load
        self._loaded: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, clean: bool = False) -> AgreementTables:
        """Tables of a folder. Empty texts are read as NULL; for tables that `ingest` wrote, `clean` spares the test."""
        return cls(spark, lambda name: _as_stored(spark.read.parquet(f"{folder}/{name}"), clean))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, names: Mapping[str, str] | None = None, clean: bool = False) -> AgreementTables:
        """Tables of a catalog database; `names` maps a table of the model to its name there, `clean` as above."""
        names = names or {}
        return cls(spark, lambda name: _as_stored(spark.table(f"{database}.{names.get(name, name)}"), clean))

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> AgreementTables:
        return cls(spark, lambda name: frames[name])


def _as_stored(df: DataFrame, clean: bool) -> DataFrame:
    return df if clean else empty_as_null(df)


def ingest(df: DataFrame, path: str) -> None:
    """Write a table with empty texts as NULL, so that filters on its text columns reach the file scan."""
    write_table(empty_as_null(df), path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a rewritten table to a new path; the input is never overwritten in place."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
