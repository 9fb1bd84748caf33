"""The registered queries of the subpackage over the smallest tables."""

import pytest

import __spark_entry__ as registered
from compare import compare
from pactlens.llm.queries import ORACLES, QUERIES

NATIVE = ("op4_license_scan", "op9_quality_rules")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, folder, name):
    difference, _ = compare(duck, name, QUERIES[name](spark, folder))
    assert difference is None


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_run_no_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not [text for text in ("Python", "Pandas", "InArrow") if text in plan]


def test_row_for_each_document(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op1_simhash_dedup", "op6_quality_classifier", "op9_quality_rules"):
        assert QUERIES[name](spark, folder).count() == documents
