"""Maintenance jobs: each returns the rewritten table, to be written to a new path or merged by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.operators.aggregates import with_flag


def clone_rows(df: DataFrame, which: Column, **changes) -> DataFrame:
    """Copies of the chosen rows with some columns replaced."""
    copies = df.where(which)
    return copies.withColumns({name: F.lit(value).cast(df.schema[name].dataType) for name, value in changes.items()})


def append_clones(df: DataFrame, which: Column, **changes) -> DataFrame:
    """The table with copies of the chosen rows appended."""
    return df.unionByName(clone_rows(df, which, **changes))


def set_where(df: DataFrame, which: Column, **changes) -> DataFrame:
    """UPDATE ... SET ... WHERE: rows for which the test is true get the new values."""
    return df.withColumns(
        {name: F.when(which, F.lit(value).cast(df.schema[name].dataType)).otherwise(F.col(name)) for name, value in changes.items()}
    )


def set_where_in(df: DataFrame, key: str, keys: DataFrame, **changes) -> DataFrame:
    """UPDATE ... WHERE key IN (subquery)."""
    flagged = with_flag(df, keys, key, "is_target")
    return set_where(flagged, F.col("is_target") == "Y", **changes).drop("is_target")


def update_files(spark: SparkSession, path: str, target: str, key: str, keys: DataFrame, **changes) -> DataFrame:
    """UPDATE ... WHERE key IN (keys) on a stored table, file by file: only files that hold a matching key are read whole
    and rewritten, to the new folder `target`; all others stay as they are.

    Returns the table's files with their state: kept, replaced (to be dropped by the caller) or new. What passes
    through the driver are names of files.
    """
    table = spark.read.parquet(path)
    placed = table.select(key, F.col("_metadata.file_path").alias("file"))
    touched = [row.file for row in placed.join(keys.select(key).distinct(), key, "left_semi").select("file").distinct().collect()]
    new: list[str] = []
    if touched:
        held = spark.read.option("basePath", path).schema(table.schema).parquet(*touched)
        set_where_in(held, key, keys, **changes).select(table.columns).write.parquet(target)
        new = spark.read.parquet(target).inputFiles()
    replaced = {_plain(name) for name in touched}
    states = [(name, "replaced" if _plain(name) in replaced else "kept") for name in table.inputFiles()] + [(name, "new") for name in new]
    return spark.createDataFrame(states, "file string, state string")


def _plain(uri: str) -> str:
    """A file's name whichever way its scheme is written."""
    return uri.split(":", 1)[-1].lstrip("/")


def read_files(spark: SparkSession, files: DataFrame, like: DataFrame) -> DataFrame:
    """The table made of the files that `update_files` kept or wrote, in the columns of `like`."""
    names = [row.file for row in files.where("state <> 'replaced'").collect()]
    return spark.read.schema(like.schema).parquet(*names) if names else like.where(F.lit(False))


def reject_customers(leads: DataFrame, customers: DataFrame, customer_codes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Reject all leads of the named customers and inactivate the customers; both tables rewritten from one key set."""
    named = F.col("customer_code").isin(list(customer_codes))
    keys = customers.where(named).select("customer_profile_id")
    return set_where_in(leads, "customer_profile_id", keys, status="REJECTED"), set_where(
        customers, named, customer_status="INACTIVE"
    )


def text_violations(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows whose text is longer than the column may hold."""
    return df.where(F.char_length(column) > limit)


def require_text_width(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The table itself; a row with a longer text fails the job that reads it."""
    message = F.concat(F.lit(f"{column} is longer than {limit} characters: "), F.char_length(column).cast("string"))
    fits = F.when(F.char_length(column) > limit, F.raise_error(message).cast("string")).otherwise(F.col(column))
    return df.withColumn(column, fits)


def widen_catalog_text(spark: SparkSession, tables: Sequence[str], column: str, limit: int) -> None:
    """Declare the column VARCHAR(limit) in several catalog tables, say a base table and its audit copy.

    For catalogs that can change a column's type; elsewhere use `copy_widened`.
    """
    for table in tables:
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN {column} TYPE VARCHAR({limit})")


def copy_widened(df: DataFrame, target: str, column: str, limit: int, using: str = "parquet") -> None:
    """Write the table as a new catalog table whose column is VARCHAR(limit); Spark refuses longer texts."""
    columns = [
        f"`{field.name}` {f'VARCHAR({limit})' if field.name == column else field.dataType.simpleString()}" for field in df.schema.fields
    ]
    df.sparkSession.sql(f"CREATE TABLE {target} ({', '.join(columns)}) USING {using}")
    df.write.insertInto(target)
