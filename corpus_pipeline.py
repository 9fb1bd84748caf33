"""Cleaning and packing of a document table in five stages, each on all that the one before it kept.

Verdicts hold for rows, not for ids: the classifier and the suffix-array stage carry whole rows through their operator; the
quality rules and the near-duplicate stage judge rows by a number that is written with them first. So documents without an
id, or with an id that others have too, are judged, kept and changed like all others. doc_id only orders: of a group of
near-duplicates the smallest one stays (rows without one last, ties by row number), and repeated passages stay where
the id is smallest. Columns beyond those of documents are carried through to the last stage. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import packing, quality_classifier, quality_rules, simhash, suffix_dedup
from pactlens.llm.common import table, whole_rows
from pactlens.llm.queries import WORD_TOKENIZER
from pactlens.session import materialize, scratch_path


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (column row) with a number each, written, so that every reader sees the same numbers."""
    return materialize(whole_rows(docs).withColumn("number", F.monotonically_increasing_id()), "rows")


def _without(held: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered rows less those of `gone` (number), as documents."""
    return held.join(gone.select("number"), "number", "left_anti").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labelled ones among them."""
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), with_rows=True)
    return judged.where("kept").select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    held = _numbered(docs)
    judged = quality_rules.judge(held.select(F.col("number").alias("doc_id"), "row.text", "row.lang"))
    return _without(held, judged.where(~F.col("kept")).select(F.col("doc_id").alias("number")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that simhash links, by its own shingle length and number of differing bits."""
    held = _numbered(docs)
    found = simhash.near_duplicates(held.select(F.col("number").alias("doc_id"), "row.text"))
    placed = held.select("number", F.col("row.doc_id").alias("id")).join(found.select(F.col("doc_id").alias("number"), "component_id"), "number")
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "number")
    stays = placed.groupBy("component_id").agg(F.min(first)["number"].alias("number"))
    return _without(held, placed.join(stays, "number", "left_anti"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that one with a smaller id holds too; n_chars follows the text."""
    found = suffix_dedup.remove_repeats(docs, with_text=True, with_rows=True)
    own = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[own.get(name, F.col(f"row.`{name}`")).alias(name) for name in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, WORD_TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classifier),
    ("quality_rules", rules),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the fingerprints and the packing are beyond SQL; a test holds every stage against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
