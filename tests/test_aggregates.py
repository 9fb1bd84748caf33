import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pactlens.operators.aggregates import chunked_lists, latest, lowest, ordered_lists
from pactlens.operators.exchange import with_rate
from pactlens.operators.joins import contact_people, headline_groups, join_hot, left_join_hot, left_join_spread, names_of_code_lists


def test_ordered_list_skips_null_and_keeps_order(spark):
    df = spark.createDataFrame(
        [(1, "b", 2), (1, "a", 1), (1, None, 0), (1, "c", None), (2, None, 1)], "k INT, v STRING, o INT"
    )
    rows = ordered_lists(df, ["k"], {"list": (F.col("v"), [F.col("o")], "~")}, also={"n": F.count(F.lit(1))}).collect()
    assert {row.k: (row.list, row.n) for row in rows} == {1: ("a~b~c", 4), 2: (None, 1)}


def test_long_list_comes_whole(spark):
    df = spark.range(70).select(F.lit(1).alias("k"), "id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1_000_000)).alias("v"))
    row = ordered_lists(df, ["k"], {"list": (F.col("v"), [F.col("id")], ",")}).select(F.length("list").alias("n"), F.substring("list", -1_000_003, 3).alias("last")).first()
    assert row.n == 70 * 1_000_000 + 10 + 60 * 2 + 69 and row.last == ",69"


def hot_parent(spark, rows=40_000):
    """A third of all entries belong to one parent; NULL parents, values and order keys occur."""
    rng = random.Random(11)
    data = []
    for n in range(rows):
        parent = 7 if n % 3 == 0 else rng.choice([None, *range(200)])
        data.append((parent, rng.choice(["x", "y", None]), rng.choice([None, rng.randint(0, 50)]), n, rng.choice([None, f"v{n}", "same"])))
    return spark.createDataFrame(data, "k INT, k2 STRING, o INT, id INT, v STRING").repartition(6)


def test_lists_in_chunks_are_the_same(spark):
    df = hot_parent(spark, 6000)
    order = [F.col("o"), F.col("id")]
    lists = {"a": (F.col("v"), order, "~"), "b": (F.upper("v"), order, ","), "c": (F.col("id"), [F.col("id")], ";")}
    also = {"n": F.count(F.lit(1))}
    key = lambda row: str(tuple(row))
    whole = sorted(ordered_lists(df, ["k", "k2"], lists, also).collect(), key=key)
    assert sorted(chunked_lists(df, ["k", "k2"], lists, also).collect(), key=key) == whole
    assert sorted(ordered_lists(df, ["k", "k2"], lists, also, most=100).collect(), key=key) == whole
    single = {"a": (F.col("v"), [F.col("o")], "~")}
    assert sorted(chunked_lists(df, ["k"], single).collect(), key=key) == sorted(ordered_lists(df, ["k"], single).collect(), key=key)
    assert ordered_lists(df.where("false"), ["k"], single).count() == 0


def test_entries_of_a_hot_parent_are_in_several_tasks(spark):
    df = hot_parent(spark)
    plan = chunked_lists(df, ["k"], {"a": (F.col("v"), [F.col("o"), F.col("id")], "~")})._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "SPARK_PARTITION_ID" in plan.upper()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange("k", F.col("o").asc_nulls_last(), F.col("id").asc_nulls_last())
        held = [r.n for r in ranged.where("k = 7").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 1 and max(held) < 0.9 * sum(held)


def test_top_and_bottom(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 9), (1, "z", None), (2, "q", None)], "k INT, v STRING, o INT")
    rows = df.groupBy("k").agg(latest(F.col("v"), F.col("o")).alias("top"), lowest(F.col("v"), F.col("v")).alias("low")).collect()
    assert {row.k: (row.top, row.low) for row in rows} == {1: (None, None), 2: (None, "q")}


def test_rate_is_latest_on_or_before(spark):
    rng = random.Random(5)
    start = dt.datetime(2019, 1, 1)
    rates = [
        (currency, "QQ", start + dt.timedelta(days=rng.randint(0, 700)), rng.randint(1, 999))
        for currency in ("AA", "BB")
        for _ in range(12)
    ] + [("AA", "ZZ", start, 5)]
    rates = list({row[:3]: row for row in rates}.values())
    facts = [(n, rng.choice(["AA", "BB", "QQ", "CC"]), start + dt.timedelta(days=rng.randint(-50, 1500), hours=n % 24)) for n in range(200)]
    fact_frame = spark.createDataFrame(facts, "id INT, currency STRING, day TIMESTAMP_NTZ")
    rate_frame = spark.createDataFrame(rates, "currency STRING, target_currency STRING, valid_from TIMESTAMP_NTZ, rate INT").withColumn(
        "rate", F.col("rate").cast("decimal(9,3)")
    )
    rows = with_rate(fact_frame, rate_frame, F.col("currency"), F.col("day"), "QQ").collect()
    assert len(rows) == len(facts)
    for row in rows:
        known = [r for r in rates if r[0] == row.currency and r[1] == "QQ" and r[2] <= row.day]
        want = 1 if row.currency == "QQ" else max(known, key=lambda r: r[2])[3] if known else None
        assert (row.fx_rate if row.fx_rate is None else int(row.fx_rate)) == want


def test_hot_headers_are_dealt_over_tasks(spark):
    """A header with a third of all groups, under a session without adaptive skew joins."""
    groups = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 997).alias("h"), F.col("id").alias("g"))
    headers = spark.range(1200).select(F.col("id").cast("int").alias("h"), F.concat(F.lit("n"), "id").alias("name"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = join_hot(groups, headers, "h")
        held = joined.where("h = 5").groupBy(F.spark_partition_id().alias("p")).count().collect()
        got = sorted(map(tuple, joined.select("h", "g", "name").collect()))
        left = sorted(map(str, map(tuple, left_join_hot(headers, groups, "h").select("h", "name", "g").collect())))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(held) == 4 and max(r["count"] for r in held) < 0.5 * sum(r["count"] for r in held)
    plain = groups.join(headers, "h").select("h", "g", "name")
    assert got == sorted(map(tuple, plain.collect()))
    assert left == sorted(map(str, map(tuple, headers.join(groups, "h", "left").select("h", "name", "g").collect())))


def test_hot_join_of_nothing(spark):
    groups, headers = spark.range(0).withColumnRenamed("id", "h"), spark.range(3).select(F.col("id").alias("h"), F.lit(1).alias("v"))
    assert join_hot(groups, headers, "h").count() == 0 and left_join_hot(headers, groups.withColumn("w", F.lit(1)), "h").count() == 3


def test_left_join_spread_keeps_rows_without_key(spark):
    facts = spark.createDataFrame([(n, n % 7 if n % 3 else None) for n in range(300)], "id INT, parent INT")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 7, 2)], "pk INT, v STRING")
    rows = left_join_spread(facts, lookup, "parent", "pk", "id").collect()
    assert {r.id: r.v for r in rows} == {n: (f"v{n % 7}" if n % 3 and (n % 7) % 2 == 0 else None) for n in range(300)}


def test_headline_group_prefers_master(spark):
    df = spark.createDataFrame(
        [(1, 10, None, 1, 2), (1, 11, "Y", 3, 4), (1, 12, "Y", 5, 6), (2, 20, "N", 7, None), (2, 21, None, 8, 9)],
        "inc_hdr_id INT, agreement_group_id INT, master_agreement STRING, expected_base_revenue INT, forecast_base_rev INT",
    )
    rows = headline_groups(df).collect()
    assert {r.inc_hdr_id: (r.agreement_group_id, r.forecast_base_rev) for r in rows} == {1: (11, 4), 2: (20, None)}


def test_role_names_once_per_role(spark):
    df = spark.createDataFrame([(1, "R2, R1,R2"), (2, "R9"), (3, None)], "id INT, roles STRING")
    roles = spark.createDataFrame([("R1", "one"), ("R2", "two"), ("R2", "zwei")], "code STRING, name STRING")
    rows = names_of_code_lists(df, "roles", roles, "code", "name", "names", ",", ("code", "name")).collect()
    assert {r.id: r.names for r in rows} == {1: "one,two,zwei", 2: None, 3: None}


def test_contact_without_mail(spark):
    contacts = spark.createDataFrame(
        [(1, 7, "SMEADMIN", "A", None), (2, 7, "SMEADMIN", None, "B"), (3, 7, "PA", "P", "Q"), (4, 8, "STAFF", "x", "y")],
        "contact_detail_id INT, customer_profile_id INT, contact_type STRING, first_name STRING, last_name STRING",
    )
    mails = spark.createDataFrame(
        [(1, "EMAIL", "m1"), (2, "PHONE", "p2"), (3, "EMAIL", "z"), (3, "EMAIL", "b")],
        "contact_detail_id INT, communication_type STRING, communication_value STRING",
    )
    rows = contact_people(contacts, mails).collect()
    assert [(r.customer_profile_id, r.cpname, r.cpemail, r.paname, r.paemail) for r in rows] == [(7, " B", "m1", "P Q", "b")]
