import datetime as dt
import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactlens.plans import children, measures
from pactlens.schemas import TIER_LABELS
from pactlens.functions.conditional import label

TODAY = dt.date(2021, 9, 7)


def status_rule(product, status, pending, start, end):
    """The rule, read in order."""
    today = dt.datetime.combine(TODAY, dt.time())
    if status == "EXPIRED":
        return status
    if product == "PLB":
        return None
    if status == "INITIAL":
        return "INITIAL"
    if status in ("PENDIING", "ACCEPTED", "SUSPENDED"):
        return "PENDING"
    if status == "APPROVED" and pending is not None and pending != "Not Applicable":
        return "PENDING"
    if status == "TERMINATED":
        return "TERMINATED"
    ready = status == "APPROVED" and pending == "Not Applicable"
    if ready and ((start and start >= today) or (end and end >= today)):
        return "ACTIVE"
    if status == "CANCELLED":
        return "CANCELLED"
    if ready and end and end < today:
        return "EXPIRED"
    return status


def test_derived_status_over_its_domain(spark):
    statuses = "INITIAL PENDING PENDIING ACCEPTED SUSPENDED APPROVED TERMINATED CANCELLED REJECTED EXPIRED OTHER".split() + [None]
    pendings = [None, "Not Applicable", "R1"]
    dates = [None, dt.datetime(2021, 9, 6, 23), dt.datetime(2021, 9, 7), dt.datetime(2022, 1, 1)]
    rows = list(itertools.product(statuses, pendings, dates, dates))
    df = spark.createDataFrame(
        [(n, *row) for n, row in enumerate(rows)],
        "id INT, status STRING, task_pending_with STRING, effective_from TIMESTAMP_NTZ, effective_to TIMESTAMP_NTZ",
    )
    for product in ("MAGIQ", "PLB"):
        got = df.select("id", measures.derived_status(product, TODAY).alias("s")).collect()
        assert {r.id: r.s for r in got} == {n: status_rule(product, *row) for n, row in enumerate(rows)}


AMOUNTS = "initial_expected_rev decimal(24,8), forecast_expected_rev decimal(24,8), expected_payout decimal(24,8), forecast_payout decimal(24,8)"


@pytest.fixture(scope="module")
def ratio_rows(spark):
    d = Decimal
    rows = [
        (1, "APPROVED", d(200), d(300), d(20), d(45)),
        (2, "APPROVED", d(0), d(300), d(0), d(45)),
        (3, "APPROVED", d("10.0004"), d(5), d(10), d(1)),
        (4, "CANCELLED", d(200), d(300), d(20), d(45)),
        (5, "APPROVED", None, d(300), d(20), d(45)),
        (6, "APPROVED", d(10), d(0), d(10), d(1)),
        (7, None, d(200), None, d(20), d(0)),
    ]
    df = measures.add_ratios(spark.createDataFrame(rows, f"id INT, status STRING, {AMOUNTS}"))
    return {row.id: row for row in df.collect()}


def test_ratios(ratio_rows):
    row = ratio_rows[1]
    assert (row.var_revenue, row.var_payout) == (Decimal("50"), Decimal("125"))
    assert (row.initial_cos, row.revised_cos) == (Decimal("10"), Decimal("15"))
    assert (row.qr_benefit, row.var_qr_benefit_perc) == (Decimal("255"), Decimal("41.67"))


def test_zero_denominators_give_null(ratio_rows):
    row = ratio_rows[2]
    assert row.var_revenue is None and row.var_payout is None and row.initial_cos is None
    assert row.var_qr_benefit_perc == 0
    assert ratio_rows[6].revised_cos is None


def test_benefit_that_rounds_to_zero_gives_null(ratio_rows):
    assert ratio_rows[3].var_qr_benefit_perc is None


def test_closed_and_missing(ratio_rows):
    assert all(ratio_rows[4][name] is None for name in measures.RATIOS)
    assert ratio_rows[5].var_revenue is None and ratio_rows[5].var_qr_benefit_perc is None
    assert ratio_rows[5].var_payout == 125
    # A missing status is not a closed one; a missing forecast counts 0 in the variance.
    assert ratio_rows[7].var_revenue == -100 and ratio_rows[7].revised_cos is None


def test_forecast_base(spark):
    columns = """id INT, status STRING, parent_inc_id INT, incremental_revenue decimal(18,4), has_headline BOOLEAN,
        headline_forecast decimal(18,4), headline_expected decimal(18,4), parent_has_group BOOLEAN, parent_forecast decimal(18,4)"""
    d = Decimal
    rows = [
        (1, "TERMINATED", 9, d(5), True, d(7), d(8), True, d(1), 0),
        (2, "TERMINATED", None, d(5), True, None, d(8), None, None, 0),
        (3, "APPROVED", 9, d(5), True, d(7), d(8), True, d(1), 0),
        (4, "APPROVED", 9, d(5), True, d(7), d(8), True, None, 5),
        (5, "APPROVED", 9, d(5), True, d(7), d(8), None, None, None),
        (6, "APPROVED", None, d(5), True, None, d(8), None, None, 8),
        (7, "APPROVED", None, d(5), None, None, None, None, None, None),
        (8, None, None, d(5), True, d(7), d(8), None, None, 7),
    ]
    df = spark.createDataFrame([row[:-1] for row in rows], columns)
    got = {r.id: r.v for r in df.select("id", measures.forecast_base().alias("v")).collect()}
    assert got == {row[0]: row[-1] for row in rows}


def test_payouts_of_cancelled_addenda_count_zero(spark):
    rules = spark.createDataFrame(
        [
            (1, 100, None, 10, 1, 50, "VALUE"),
            (2, 100, 7, 20, 2, 60, "VALUE"),
            (3, 100, 8, 40, 4, 70, "PERC"),
            (4, 200, None, None, None, None, "PERC"),
        ],
        "rule_comp_hdr_id INT, rule_header_id INT, add_hdr_id INT, expected_payout INT, forecast_payout INT, max_payout INT, value_type STRING",
    )
    addenda = spark.createDataFrame([(7, "CANCELLED"), (7, "CANCELLED"), (8, "APPROVED")], "add_hdr_id INT, status STRING")
    got = {r.inc_hdr_id: r for r in children.payout_sums(rules, addenda).collect()}
    row = got[100]
    assert (row.expected_sum, row.forecast_sum, row.fixed_sum, row.all_forecast_sum, row.max_sum) == (50, 5, 30, 7, 180)
    assert got[200].expected_sum is None and got[200].fixed_sum is None


def test_labels(spark):
    df = spark.createDataFrame([("EL",), ("ZZ",), (None,)], "c STRING")
    assert [r.v for r in df.select(label(F.col("c"), TIER_LABELS).alias("v")).collect()] == ["Elevate", "ZZ", None]


def test_first_slab_target_switches_on_overall_slabs(spark):
    rules = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 20, 2), (4, 20, 3), (5, 30, 9)], "rule_comp_hdr_id INT, rule_header_id INT, rbd_value INT")
    periods = rules.selectExpr("rule_comp_hdr_id AS rule_comp_period_id", "rule_comp_hdr_id")
    values = periods.selectExpr("rule_comp_period_id", "'1' AS slab_number", "CAST(rule_comp_period_id * 100 AS DECIMAL(18,4)) AS measure_from")
    products = spark.createDataFrame([(1, "PLBOVERALL"), (2, "PLBPREM"), (3, "PLBECO"), (9, "X")], "rbd_product_id INT, booking_product_code STRING")
    got = {r.inc_hdr_id: (r.tier1_target, r.has_overall) for r in children.first_slab_targets(rules, periods, values, products).collect()}
    assert got == {10: (2, "Y"), 20: (14, "N")}
