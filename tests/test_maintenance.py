import pytest
from pyspark.sql import functions as F

from pactlens.operators import balances, maintenance
from pactlens.sources.tables import append_rows, write_table


def test_update_leaves_null_and_others(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "y"), (None, "z")], "code STRING, text STRING")
    rows = maintenance.set_where(df, F.col("code") == "A", text="new").collect()
    assert {(r.code, r.text) for r in rows} == {("A", "new"), ("B", "y"), (None, "z")}


def test_clone_is_appended(spark, tmp_path):
    df = spark.createDataFrame([("A", "x", 1), ("B", "y", 2)], "code STRING, text STRING, n INT")
    path = str(tmp_path / "codes")
    write_table(df, path)
    append_rows(maintenance.clone_rows(df, F.col("code") == "A", code="C", text="copy"), path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("A", "x", 1), ("B", "y", 2), ("C", "copy", 1)}
    with pytest.raises(Exception, match="already exists"):
        write_table(df, path)


def test_cascade_uses_one_key_set(spark):
    leads = spark.createDataFrame([(1, 10, "OPEN"), (2, 20, "OPEN"), (3, None, "OPEN")], "lead_id INT, customer_profile_id INT, status STRING")
    customers = spark.createDataFrame(
        [(10, "C1", "ACTIVE"), (20, "C2", "ACTIVE"), (30, "C1", "ACTIVE")], "customer_profile_id INT, customer_code STRING, customer_status STRING"
    )
    new_leads, new_customers = maintenance.reject_customers(leads, customers, ["C1"])
    assert {r.lead_id: r.status for r in new_leads.collect()} == {1: "REJECTED", 2: "OPEN", 3: "OPEN"}
    assert {r.customer_profile_id: r.customer_status for r in new_customers.collect()} == {10: "INACTIVE", 20: "ACTIVE", 30: "INACTIVE"}


def test_text_width(spark):
    df = spark.createDataFrame([(1, "é" * 1000), (2, "x" * 1001), (3, None)], "id INT, remarks STRING")
    assert [r.id for r in maintenance.text_violations(df, "remarks", 1000).collect()] == [2]
    with pytest.raises(Exception, match="longer than 1000"):
        maintenance.require_text_width(df, "remarks", 1000).collect()
    assert maintenance.require_text_width(df.where("id <> 2"), "remarks", 1000).count() == 2


def test_base_and_audit_copies_hold_the_new_width(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS widths")
    for name in ("base", "audit"):
        spark.sql(f"DROP TABLE IF EXISTS widths.{name}")
        fits = spark.createDataFrame([(1, "x" * 1000), (2, None)], "id INT, remarks STRING")
        maintenance.copy_widened(fits, f"widths.{name}", "remarks", 1000)
        assert spark.table(f"widths.{name}").count() == 2
    with pytest.raises(Exception, match="1000"):
        spark.createDataFrame([(3, "x" * 1001)], "id INT, remarks STRING").write.insertInto("widths.base")


def test_update_touches_only_files_with_a_match(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 100).alias("customer"), F.col("id").alias("lead"), F.lit("OPEN").alias("status"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5000, "OPEN")], rows.schema))
    path, target = f"file://{tmp_path}/leads", f"file://{tmp_path}/new"
    rows.repartitionByRange(10, "customer").write.parquet(path)
    before = {f.name: (f.stat().st_mtime_ns, f.stat().st_size) for f in (tmp_path / "leads").glob("*.parquet")}
    files = maintenance.update_files(spark, path, target, "customer", spark.createDataFrame([(42,), (42,), (None,)], "customer LONG"), status="REJECTED")
    states = [r.state for r in files.collect()]
    assert states.count("replaced") == 1 and states.count("kept") == len(before) - 1 and states.count("new") >= 1
    assert {f.name: (f.stat().st_mtime_ns, f.stat().st_size) for f in (tmp_path / "leads").glob("*.parquet")} == before
    got = sorted(map(str, map(tuple, maintenance.read_files(spark, files, rows).collect())))
    want = rows.withColumn("status", F.when(F.col("customer") == 42, "REJECTED").otherwise(F.col("status")))
    assert got == sorted(map(str, map(tuple, want.collect())))
    nothing = maintenance.update_files(spark, path, f"{target}2", "customer", spark.createDataFrame([(777,)], "customer LONG"), status="X")
    assert {r.state for r in nothing.collect()} == {"kept"}


def test_balances_after_three_batches(spark, tmp_path):
    import datetime as dt
    import random
    from decimal import Decimal

    draw = random.Random(2)
    money = lambda: draw.choice([None, Decimal(draw.randrange(10**6)) / 10000])
    rows = [
        (draw.choice(["D1", "D2", None]), f"M{draw.randrange(3)}", draw.choice([None, dt.date(2023, draw.randrange(1, 13), draw.randrange(1, 4))]), money(), money(), money(), money())
        for _ in range(900)
    ]
    schema = "track_code string, membership_no string, miles_expiry_date date, " + ", ".join(f"{name} decimal(18,4)" for name in balances.AMOUNTS)
    path = f"file://{tmp_path}/state"
    balances.start_balances(spark.createDataFrame(rows[:300], schema), path)
    only_march = [r for r in rows[300:500] if r[2] and r[2].month == 3]
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("*.parquet")}
    before = files()
    assert balances.add_balances(spark, path, spark.createDataFrame(only_march, schema)) == ["2023-03"]
    assert {f for f in before if "2023-03" not in f} == {f for f in files() if "2023-03" not in f}
    balances.add_balances(spark, path, spark.createDataFrame(rows[500:900], schema))
    assert balances.add_balances(spark, path, spark.createDataFrame([], schema)) == []
    every = spark.createDataFrame(rows[:300] + only_march + rows[500:900], schema)
    want = every.groupBy(*balances.KEYS).agg(*[F.sum(name).cast("decimal(28,4)").alias(name) for name in balances.AMOUNTS])
    key = lambda r: str(tuple(r))
    assert sorted(map(key, balances.read_balances(spark, path).collect())) == sorted(map(key, want.collect()))
