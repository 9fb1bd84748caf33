"""What several operators share: tables, Arrow batches of texts, and the workers' import path."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.session import scratch_path

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return. `bytes.split` cuts at the same.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Python workers can import this package from here on."""
    reach_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Workers are used again by later tasks. So that they hold little in between, large arrays are mapped on their own and freed memory goes back.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Bytes of an Arrow batch, so that neither a worker nor its executor holds the texts of a whole task. A session's own setting counts.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def reach_package(spark: SparkSession) -> None:
    """Put this package's folder on the Python path of the workers that start from now on; they give freed memory back and get small batches."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*map(str, BATCH_BYTES))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if top not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [top, known]))


_memories: list[Callable[[], None]] = []


def remembered(forget: Callable[[], None]) -> None:
    """`forget` drops what this worker keeps for later tasks of an operator."""
    if forget not in _memories:
        _memories.append(forget)


def forget_others() -> None:
    """Drop what earlier operators keep in this worker; called by tasks of one that needs the room and keeps nothing itself."""
    while _memories:
        _memories.pop()()


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text of a batch; a null text is empty."""
    for value in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()):
        yield value.as_py() or b""


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit words as Spark's longs."""
    return values.view(np.int64)


def ids_and_text(documents: DataFrame) -> DataFrame:
    """The two columns an operator on texts reads, whatever else the table holds."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def whole_rows(documents: DataFrame) -> DataFrame:
    """One column, `row`: each row as a struct, safe from names that an operator uses beside it."""
    return documents.select(F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("row"))


def materialize_in_buckets(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """`df` written once in the shared folder, in buckets of `key`: joins and aggregations by `key` read it without an exchange.

    Spark keeps a bucketed side in place when it has at least spark.sql.shuffle.partitions buckets. The catalog's entry only
    serves to read the files as buckets and goes at once; the files go with the other scratch copies.
    """
    spark = df.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"pactlens_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, label)).saveAsTable(name)
    held = spark.table(name)
    held.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")
    return held
