import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pactlens.operators import ranking


def frame(spark, dates):
    rows = list(enumerate(dates))
    return spark.createDataFrame(rows, "id INT, created TIMESTAMP_NTZ").repartition(5)


def expected(dates):
    """RANK() with NULL newest."""

    def later(a, b):
        return b is not None and (a is None or a > b)

    return {n: 1 + sum(later(other, date) for other in dates) for n, date in enumerate(dates)}


def made_up(seed, size):
    rng = random.Random(seed)
    base = dt.datetime(2021, 10, 7, 9, 40, 5)
    # A third of all rows share one date; others differ by days, seconds or microseconds.
    dates = [base] * (size // 3) + [None] * 3
    while len(dates) < size:
        dates.append(base + rng.choice([dt.timedelta(days=1), dt.timedelta(seconds=1), dt.timedelta(microseconds=1)]) * rng.randint(-5, 5))
    rng.shuffle(dates)
    return dates


@pytest.mark.parametrize("seed,hot_share", [(1, 1000), (2, 4), (3, 1)])
def test_rank_equals_brute_force(spark, monkeypatch, seed, hot_share):
    monkeypatch.setattr(ranking, "HOT_SHARE", hot_share)
    dates = made_up(seed, 60)
    rows = ranking.with_rank(frame(spark, dates), "created").collect()
    assert {row.id: row.rnk for row in rows} == expected(dates)


def test_pages_partition_the_ranked_rows(spark):
    dates = made_up(4, 40)
    df, ranks, size = frame(spark, dates), expected(dates), 7
    seen = {}
    for number in range(1, 8):
        for row in ranking.page_by_rank(df, "created", number, size).collect():
            assert row.id not in seen
            assert (number - 1) * size < row.rnk <= number * size
            seen[row.id] = row.rnk
    assert seen == ranks


def test_tie_over_the_page_edge_stays_whole(spark):
    day = dt.datetime(2020, 1, 1)
    df = frame(spark, [day + dt.timedelta(days=1)] + [day] * 5 + [day - dt.timedelta(days=1)])
    first = ranking.page_by_rank(df, "created", 1, 3).count()
    second = ranking.page_by_rank(df, "created", 2, 3).count()
    third = ranking.page_by_rank(df, "created", 3, 3).count()
    assert (first, second, third) == (6, 0, 1)


def test_only_day_totals_pass_an_unpartitioned_window(spark):
    df = ranking.rank_of_values(spark.range(10).select(F.lit(dt.datetime(2020, 1, 1)).alias("created")), "created")
    assert df.first().rnk == 1


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rank_around_a_clock_change(spark, kind):
    """01:30 and 01:45 summer time, then 01:30 winter time: later instants come first."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        seconds = spark.createDataFrame([(1, 1636263000), (2, 1636263900), (3, 1636266600), (4, -5)], "id int, s long")
        created = F.timestamp_seconds("s")
        if kind == "timestamp_ntz":
            created = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")
        rows = ranking.with_rank(seconds.select("id", created.alias("created")), "created").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {row.id: row.rnk for row in rows} == {3: 1, 2: 2, 1: 3, 4: 4}
