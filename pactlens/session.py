"""Session set-up and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def build_session(app_name: str = "pactlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs are tuned for. On a cluster leave `master` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, else a folder in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/pactlens-{label}-{uuid.uuid4().hex}"
    _OWN.append(path)
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` once and read it back.

    The copy lies in the shared folder, so it outlives a lost executor, is not recomputed by
    each of its readers, and carries real file sizes for Spark's own broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession, since: int = 0) -> None:
    """Delete the copies this process has made; results that still read them must have been written before."""
    paths, _OWN[since:] = _OWN[since:], []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Copies made inside the block are deleted at its end: write the results inside it."""
    before = len(_OWN)
    try:
        yield
    finally:
        cleanup(spark, before)
