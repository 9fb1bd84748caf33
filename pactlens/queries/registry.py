"""Registry of queries and of the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.queries.fragments import AS_OF  # noqa: F401
from pactlens.sources.standins import DUCKDB, standin_sql, standin_tables
from pactlens.sources.tables import AgreementTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STANDINS = standin_sql(DUCKDB)


def portable(df: DataFrame) -> DataFrame:
    """Result columns in types both engines share: whole numbers, doubles, text."""

    def convert(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.NullType):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[convert(field) for field in df.schema.fields])


def stamp(column: str, name: str | None = None) -> str:
    """SQL text of a timestamp column as `portable` writes it."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column.split('.')[-1]}"


def day(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {name or column.split('.')[-1]}"


def num(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name or expression.split('.')[-1]}"


def big(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression.split('.')[-1]}"


def with_standins(body: str) -> str:
    """Prefix the SQL with a CTE for every stand-in table it names."""
    body = body.strip()
    ctes = [
        f"{name} AS ({statement})" for name, (_, statement) in _STANDINS.items() if re.search(rf"\b{name}\b", body)
    ]
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register `function(tables) -> DataFrame` under `name`."""

    def register(function: Callable[[AgreementTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables = standin_tables(spark, folder)
            tables.folder = folder
            return portable(function(tables))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_standins(oracle)
        return function

    return register
