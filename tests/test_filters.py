import datetime as dt

import pytest
from pyspark.sql import functions as F

from pactlens.functions.conditional import decode
from pactlens.functions.dates import within_bounds
from pactlens.functions.text import contains_ignoring_case, empty_as_null, join_text, parse_list, split_list
from pactlens.operators import filters


def ids(df, test):
    kept = df if test is None else df.where(test)
    return {row.id for row in kept.collect()}


@pytest.fixture(scope="module")
def names(spark):
    rows = [(1, "Alpha 50% deal"), (2, "alpha_50 deal"), (3, None), (4, r"back\slash"), (5, "")]
    return spark.createDataFrame(rows, "id INT, name STRING")


def test_contains_keeps_wildcards_and_plain_backslash(names):
    column = F.col("name")
    assert ids(names, contains_ignoring_case(column, "ALPHA")) == {1, 2}
    assert ids(names, contains_ignoring_case(column, "a_50")) == {1, 2}
    assert ids(names, contains_ignoring_case(column, "50%d")) == {1, 2}
    assert ids(names, contains_ignoring_case(column, "k\\s")) == {4}
    assert ids(names, contains_ignoring_case(column, "k\\s%h")) == {4}
    assert ids(names, contains_ignoring_case(column, None)) == {1, 2, 4, 5}


def test_empty_text_is_null(names):
    assert ids(empty_as_null(names), F.col("name").isNull()) == {3, 5}


def test_join_text_counts_null_as_empty(spark):
    row = spark.range(1).select(join_text(F.lit("a"), F.lit(None), F.lit("b")).alias("t")).first()
    assert row.t == "ab"


def test_lists(spark):
    assert parse_list(" a, ,b,") == ["a", "b"]
    assert parse_list("") is None
    row = spark.range(1).select(split_list(F.lit(" x ,,y")).alias("items")).first()
    assert row["items"] == ["x", "y"]


def test_decode_matches_null(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id INT, add_hdr STRING")
    rows = df.select("id", decode(F.col("add_hdr"), {None: "MAIN"}, "ADD").alias("kind")).collect()
    assert {row.id: row.kind for row in rows} == {1: "MAIN", 2: "ADD"}


def test_optional_filters_differ_on_null(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "#")], "id INT, c STRING")
    column = F.col("c")
    assert ids(df, filters.optional_strict(column, None)) == {1, 3}
    assert ids(df, filters.optional_keep_null(column, None)) == {1, 2, 3}
    assert ids(df, filters.optional_keep_null(column, "A")) == {1}
    # A value equal to the sentinel also finds the NULLs it stands for.
    assert ids(df, filters.optional_keep_null(column, "#", "#")) == {2, 3}
    assert ids(df, filters.not_equal(column, "A")) == {3}


@pytest.fixture(scope="module")
def periods(spark):
    rows = [
        (1, "PLB", dt.datetime(2020, 1, 1), dt.datetime(2020, 12, 31, 13)),
        (2, "PLB", dt.datetime(2020, 4, 1), dt.datetime(2021, 3, 31, 23, 59)),
        (3, "OTHER", dt.datetime(2019, 1, 1), dt.datetime(2022, 1, 1)),
        (4, "OTHER", dt.datetime(2019, 1, 1), dt.datetime(2020, 4, 1)),
        (5, "OTHER", dt.datetime(2021, 3, 31, 12), None),
        (6, "PLB", dt.datetime(2019, 1, 1), dt.datetime(2020, 4, 1)),
    ]
    return spark.createDataFrame(rows, "id INT, product STRING, f TIMESTAMP_NTZ, t TIMESTAMP_NTZ")


def test_period_rules(periods):
    def found(low, high):
        return ids(periods, filters.period_matches(F.col("product"), F.col("f"), F.col("t"), low, high))

    # Fiscal year: the calendar-year agreement of a PLB request, ends touching for others, spanning one missed.
    assert found(dt.date(2020, 4, 1), dt.date(2021, 3, 31)) == {1, 2, 4, 5}
    assert found(dt.date(2020, 4, 2), dt.date(2021, 3, 31)) == {5}
    assert found(None, None) == {1, 2, 3, 4, 5, 6}


def test_created_between_counts_whole_days(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(1999, 12, 31, 23, 59)), (2, dt.datetime(2000, 1, 1)), (3, dt.datetime(2000, 5, 5, 23, 59, 59)), (4, None)],
        "id INT, c TIMESTAMP_NTZ",
    )
    assert ids(df, filters.created_between(F.col("c"), None, dt.date(2000, 5, 5))) == {2, 3}
    assert ids(df, filters.created_between(F.col("c"), None, None)) == {2, 3}


@pytest.mark.parametrize("kind", ["TIMESTAMP_NTZ", "TIMESTAMP", "DATE"])
def test_within_bounds_of_a_frame(spark, kind):
    times = [dt.datetime(2020, 1, d, 5, 6, 7, 123456) for d in (2, 3, 4)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(times)], "id INT, t TIMESTAMP_NTZ").withColumn("t", F.col("t").cast(kind))
    some = df.where("id > 0")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert ids(df, within_bounds(F.col("t"), some, "t")) == {1, 2}
        assert ids(df, within_bounds(F.col("t"), some.where("id > 5"), "t")) == set()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pending_with_both_ways(spark):
    df = spark.createDataFrame([(1, "R1,R2"), (2, "R1"), (3, None), (4, "R9")], "id INT, c STRING")
    assert ids(df, filters.pending_with(F.col("c"), "R1,R2,R3")) == {1, 2}
    assert ids(df, filters.pending_with(F.col("c"), "R2")) == {1}
    assert ids(df, filters.pending_with(F.col("c"), "ALL")) == {1, 2, 3, 4}
    assert ids(df, filters.pending_with(F.col("c"), "R4, R9")) == {4}


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(1, "QA", "QA", "Y"), (2, "DE", "QA", "N"), (3, "QA", "QA", None), (4, None, "QA", "N"), (5, "FR", None, "N")]
    return spark.createDataFrame(rows, "id INT, gc STRING, hc STRING, m STRING")


def test_sold_outside_rules(groups):
    gc, hc, m = F.col("gc"), F.col("hc"), F.col("m")

    def country(soto, search, wanted=None, outside=None):
        return ids(groups, filters.soto_country(gc, hc, m, soto, search, wanted, outside))

    assert country("N", "Y") == {1, 2, 3, 4, 5}
    assert country(None, "Y") == set()
    assert country("X", "Y") == set()
    assert country("Y", "Y") == {2, 5}
    assert country("Y", "Y", outside="FR, ES") == {5}
    assert country("Y", "N") == {2}
    assert country("Y", "N", wanted="QA", outside="DE,FR") == {2}
    assert country("Y", None) == set()
    assert ids(groups, filters.master_switch(m, None)) == {1, 3}
    assert ids(groups, filters.master_switch(m, "Y")) == {2, 4, 5}
    assert ids(groups, filters.master_switch(m, "X")) == set()
    assert ids(groups, filters.home_country_unless_soto(gc, hc, None)) == {1, 3}


def test_requested_by(spark):
    df = spark.createDataFrame([(1, "U1"), (2, None)], "id INT, c STRING")
    assert ids(df, filters.requested_by(F.col("c"), None, "U1")) == {1, 2}
    assert ids(df, filters.requested_by(F.col("c"), "Y", "U1")) == {1}
    assert ids(df, filters.requested_by(F.col("c"), "N", "U1")) == set()


def test_headers_and_groups_meet_in_partitions(spark, folder):
    """Whatever the files' sizes, headers are not broadcast to the tasks that read the groups."""
    from pactlens.queries import QUERIES

    for name in ("filter_location_scope", "filter_mode_dependent", "filter_soto_country", "filter_on_derived"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "inc_hdr_id" in line]
        assert "SortMergeJoin" in plan and not broadcast, name


def test_a_task_joins_a_bounded_number_of_headers_and_groups(spark, folder, monkeypatch):
    from pactlens.queries import QUERIES
    from pactlens.queries import filters as queries

    whole = QUERIES["filter_location_scope"](spark, folder)
    monkeypatch.setattr(queries, "TASK_ROWS", 200)
    cut = QUERIES["filter_location_scope"](spark, folder)
    assert "REPARTITION_BY_NUM" in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
