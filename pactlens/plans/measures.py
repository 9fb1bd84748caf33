"""Measures of an agreement row (one row per header and group)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.conditional import first_match, nvl, yes_no
from pactlens.functions.dates import on_or_after
from pactlens.functions.numbers import money, percent, quotient, round_half_away
from pactlens.operators.joins import names_of_code_lists
from pactlens.schemas import CLOSED_STATUSES, DEFAULT_CHANNEL, NOT_APPLICABLE, PRODUCT_BASELINE, PRODUCT_LOYALTY_BONUS

AMOUNTS = (
    "initial_expected_rev",
    "forecast_expected_rev",
    "expected_payout",
    "forecast_payout",
    "max_payout",
    "fixed_payout",
)
RATIOS = ("var_revenue", "var_payout", "initial_cos", "revised_cos", "qr_benefit", "var_qr_benefit_perc")


def derived_status(product: str, as_of: dt.date) -> Column:
    """Status shown for an agreement, from its own status, pending task and the group's dates."""
    status, pending = F.col("status"), F.col("task_pending_with")
    if product == PRODUCT_LOYALTY_BONUS:
        return F.when(status == "EXPIRED", status)
    approved = status == "APPROVED"
    running = approved & (pending == NOT_APPLICABLE)
    return first_match(
        [
            (status == "EXPIRED", status),
            (status == "INITIAL", "INITIAL"),
            # The first spelling is the one the rule tests; PENDING itself passes through the end.
            (status.isin("PENDIING", "ACCEPTED", "SUSPENDED"), "PENDING"),
            (approved & (pending != NOT_APPLICABLE), "PENDING"),
            (status == "TERMINATED", "TERMINATED"),
            (running & (on_or_after(F.col("effective_from"), as_of) | on_or_after(F.col("effective_to"), as_of)), "ACTIVE"),
            (status == "CANCELLED", "CANCELLED"),
            (running & ~on_or_after(F.col("effective_to"), as_of), "EXPIRED"),
        ],
        status,
    )


def is_closed() -> Column:
    return F.col("status").isin(*CLOSED_STATUSES)


def unless_closed(column: Column) -> Column:
    """NULL for a cancelled or rejected agreement; a NULL status leaves the value."""
    return F.when(is_closed(), F.lit(None)).otherwise(column)


def forecast_base() -> Column:
    """Unconverted forecast revenue of a header (one headline group per header)."""
    child = F.col("parent_inc_id").isNotNull()
    own_forecast = F.col("headline_forecast")
    ended = F.when(child, F.lit(0)).otherwise(nvl(own_forecast, 0))
    of_parent = F.when(
        F.col("parent_has_group"),
        F.when(F.col("parent_forecast").isNotNull(), F.lit(0)).otherwise(F.col("incremental_revenue")),
    )
    running = F.when(child, of_parent).otherwise(nvl(own_forecast, F.col("headline_expected"), 0))
    amount = F.when(F.col("status") == "TERMINATED", ended).otherwise(running)
    return F.when(F.col("has_headline"), amount)


def converted_sum(column: str) -> Column:
    """Converted sum, 0 where there is nothing to add up or no rate."""
    return money(nvl(F.col(column) * F.col("fx_rate"), 0))


def add_amounts(df: DataFrame) -> DataFrame:
    """The six amounts, converted and unrounded."""
    rate = F.col("fx_rate")
    largest = F.when(F.col("status") == "TERMINATED", converted_sum("all_forecast_sum")).otherwise(converted_sum("max_sum"))
    return df.withColumns(
        {
            "initial_expected_rev": money(nvl(F.col("expected_base_revenue"), 0) * rate),
            "forecast_expected_rev": money(forecast_base() * rate),
            "expected_payout": converted_sum("expected_sum"),
            "forecast_payout": converted_sum("forecast_sum"),
            "max_payout": largest,
            "fixed_payout": converted_sum("fixed_sum"),
        }
    )


def change_percent(before: Column, after: Column) -> Column:
    """Change in percent of the value before; NULL where that is 0 or missing."""
    return percent(nvl(after, 0) - nvl(before, 0), before)


def cost_of_sale(payout: Column, revenue: Column) -> Column:
    return percent(payout, revenue)


def benefit_change() -> Column:
    """Change of the net benefit in percent, on benefits rounded to 3 places; 0 when the initial one is 0."""
    initial_exact = F.col("initial_expected_rev") - F.col("expected_payout")
    initial = round_half_away(initial_exact, 3)
    forecast = round_half_away(F.col("forecast_expected_rev") - F.col("forecast_payout"), 3)
    change = round_half_away(quotient(forecast - initial, initial) * F.lit(100), 2)
    return F.when(initial_exact == 0, F.lit(0).cast(change_type())).otherwise(change)


def change_type() -> str:
    return "decimal(38,2)"


def add_ratios(df: DataFrame) -> DataFrame:
    """Variances, cost of sale and net benefit; NULL for closed agreements."""
    ratios = {
        "var_revenue": change_percent(F.col("initial_expected_rev"), F.col("forecast_expected_rev")),
        "var_payout": change_percent(F.col("expected_payout"), F.col("forecast_payout")),
        "initial_cos": cost_of_sale(F.col("expected_payout"), F.col("initial_expected_rev")),
        "revised_cos": cost_of_sale(F.col("forecast_payout"), F.col("forecast_expected_rev")),
        "qr_benefit": round_half_away(F.col("forecast_expected_rev") - F.col("forecast_payout"), 3),
        "var_qr_benefit_perc": benefit_change(),
    }
    return df.withColumns({name: unless_closed(column) for name, column in ratios.items()})


def round_amounts(df: DataFrame) -> DataFrame:
    """Show the amounts with 3 places; NULL for closed agreements."""
    return df.withColumns({name: unless_closed(round_half_away(F.col(name), 3)) for name in AMOUNTS})


def no_loyalty_measures(df: DataFrame) -> DataFrame:
    """All amounts and ratios NULL: the requested product has none."""
    return df.withColumns({name: F.lit(None).cast("decimal(38,3)") for name in AMOUNTS + RATIOS})


def add_baseline(df: DataFrame) -> DataFrame:
    """Baseline against actual revenue, for agreements of the baseline product only."""
    applies = F.col("sales_product_code") == PRODUCT_BASELINE
    baseline, actual = (F.when(applies, converted_sum(name)) for name in ("master_expected", "master_forecast"))
    exact = df.withColumns({"exact_baseline": baseline, "exact_actual": actual})
    gap = F.col("exact_actual") - F.col("exact_baseline")
    change = round_half_away(quotient(gap, F.col("exact_baseline")) * F.lit(100), 2)
    return exact.withColumns(
        {
            "baseline_target": round_half_away(F.col("exact_baseline"), 2),
            "actual_revenue": round_half_away(F.col("exact_actual"), 2),
            "variance_rev": round_half_away(gap, 2),
            "var_perc": F.when(F.col("exact_actual") == 0, F.lit(0).cast(change_type())).otherwise(change),
        }
    ).drop("exact_baseline", "exact_actual")


def channel_label(product: str, name: str = "channel_type") -> Column:
    return nvl(F.col(name), DEFAULT_CHANNEL) if product == PRODUCT_LOYALTY_BONUS else F.col(name)


def is_super_agreement(product: str) -> Column:
    if product != PRODUCT_LOYALTY_BONUS:
        return F.lit(None).cast("string")
    return yes_no(F.col("parent_inc_id").isNotNull())


def with_pending_label(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Text for the pending task: a fixed text, the task itself, or the names of the roles it lists."""
    named = names_of_code_lists(
        df, "task_pending_with", roles, "role_code", "role_name", "pending_roles", ",", ("role_code", "role_name")
    )
    pending = F.col("task_pending_with")
    text = first_match(
        [
            (pending == "FAREWTHDRW", "FARE WITHDRAW"),
            (F.upper(pending) == "CMS INTEGRATION", pending),
        ],
        F.col("pending_roles"),
    )
    return named.withColumn("task_pending_with_desc", text).drop("pending_roles")
