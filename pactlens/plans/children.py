"""Summaries of child tables: one grouping per child table and parent, joined back once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions.conditional import decode
from pactlens.operators.aggregates import ordered_lists
from pactlens.operators.joins import codes_of_type, having, left_join_spread, payout_chain, rule_slabs, with_lookup
from pactlens.schemas import (
    CHANNEL_CODE_TYPE,
    EXCEPTION_CODE_TYPES,
    FREQUENCY_CODE_TYPE,
    NOT_APPLICABLE,
    OVERALL_PRODUCT,
    SPLIT_PRODUCTS,
)
from pactlens.session import materialize


class AllRows:
    """Scope of a whole-table job: every child row counts."""

    def of(self, child: DataFrame, key: str, parent: str) -> DataFrame:
        return child

    def chained(self, child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return child


class PageScope:
    """Scope of one written page: only children of its headers, groups and customers are read.

    The page's key ranges go to the child scans as plain bounds (ids grow with time, so a page of new
    agreements skips most row groups); the exact test is a semi-join with the page, which Spark
    broadcasts when its files are small. What a chain needs further on is written, so that the next
    hop again starts from a frame of known size and no large table is shuffled for a small page.
    """

    KEYS = ("inc_hdr_id", "agreement_group_id", "customer_profile_id", "parent_inc_id")

    def __init__(self, page: DataFrame):
        self.page = page
        bounds = page.agg(*[edge(key).alias(f"{name}_{key}") for key in self.KEYS for name, edge in (("lo", F.min), ("hi", F.max))])
        self.bounds = bounds.first().asDict()

    def of(self, child: DataFrame, key: str, parent: str) -> DataFrame:
        """Child rows whose `key` occurs in the page's column `parent`."""
        low, high = self.bounds[f"lo_{parent}"], self.bounds[f"hi_{parent}"]
        if low is None:
            return child.where(F.lit(False))
        near = child.where(F.col(key).between(F.lit(low), F.lit(high)))
        wanted = self.page.select(F.col(parent).alias("wanted_id")).distinct()
        return near.join(wanted, near[key] == wanted["wanted_id"], "left_semi")

    def chained(self, child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """Rows of the next table of a chain, written: those whose `key` occurs in `parents`."""
        return materialize(having(child, parents, key), "page-chain")

    def start(self, child: DataFrame, key: str, parent: str) -> DataFrame:
        """First table of a chain, written."""
        return materialize(self.of(child, key, parent), "page-chain")

    def flagged(self, child: DataFrame, wanted: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
        """Rows of one table that several chains want, read once and written: flag -> (its key, keys, their column)."""
        marked = child
        for flag, (key, keys, column) in wanted.items():
            known = keys.select(F.col(column).alias(f"key_{flag}")).distinct()
            marked = marked.join(known, marked[key] == known[f"key_{flag}"], "left")
            marked = marked.withColumn(flag, F.col(f"key_{flag}").isNotNull()).drop(f"key_{flag}")
        any_flag = F.lit(False)
        for flag in wanted:
            any_flag = any_flag | F.col(flag)
        return materialize(marked.where(any_flag), "page-chain")


def addendum_lists(addenda: DataFrame) -> DataFrame:
    """Names, types, statuses and ids of a header's addenda by name, and their number."""
    order = [F.col("add_name"), F.col("add_hdr_id")]
    return ordered_lists(
        addenda,
        ["inc_hdr_id"],
        {
            "addendum": (F.col("add_name"), order, "~"),
            "addendum_type": (F.col("add_type"), order, "~"),
            "addendum_status": (F.col("status"), order, "~"),
            "addendum_id": (F.col("add_hdr_id"), order, "~"),
        },
        also={"inc_add_cnt": F.count(F.lit(1))},
    )


def open_rule_addenda(addenda: DataFrame) -> DataFrame:
    """Open rule addenda per header, consolidation status and pending task, with the list of their ids."""
    pending = F.col("task_pending_with")
    rules = addenda.where(
        (F.col("add_type") == "RULES") & (F.col("cons_status") != "COMPLETED") & (F.col("status") != "CANCELLED")
    ).withColumn("task_pending_with", decode(pending, {"NA": NOT_APPLICABLE}, pending))
    lists = {"add_hdr_id_list": (F.col("add_hdr_id"), [F.col("add_hdr_id")], ",")}
    return ordered_lists(rules, ["inc_hdr_id", "cons_status", "task_pending_with"], lists)


def exception_lists(exceptions: DataFrame) -> DataFrame:
    """Codes, types and origin of a header's exceptions by code and id."""
    order = [F.col("exception_code"), F.col("inc_exception_id")]
    origin = F.when(F.col("add_hdr_id").isNull(), "MAIN").otherwise("ADD")
    return ordered_lists(
        exceptions,
        ["inc_hdr_id"],
        {
            "exception_code": (F.col("exception_code"), order, "~"),
            "exception_type": (F.col("exception_type"), order, "~"),
            "exception_desc_type": (origin, order, "~"),
        },
    )


def exception_descriptions(exceptions: DataFrame, codes: DataFrame) -> DataFrame:
    """Descriptions of the distinct exception codes of a header, by code."""
    used = exceptions.select("inc_hdr_id", F.trim("exception_code").alias("code")).distinct()
    known = codes_of_type(codes, *EXCEPTION_CODE_TYPES)
    order = [F.col("code"), F.col("code_type"), F.col("description")]
    return ordered_lists(used.join(known, "code"), ["inc_hdr_id"], {"exception_desc": (F.col("description"), order, "~")})


def payout_sums(rules: DataFrame, addenda: DataFrame) -> DataFrame:
    """Unconverted payout sums per header; rules of a cancelled addendum (found by id) count 0 where the measure says so.

    Conversion multiplies by one rate per (header, group), so sums are converted instead of single payouts.
    """
    cancelled = (
        addenda.where(F.col("status") == "CANCELLED").select(F.col("add_hdr_id").alias("cancelled_id")).distinct()
    ).withColumn("is_cancelled", F.lit(True))
    marked = left_join_spread(rules, cancelled, "add_hdr_id", "cancelled_id", "rule_comp_hdr_id")

    def live(name: str):
        return F.sum(F.when(F.col("is_cancelled"), F.lit(0)).otherwise(F.col(name)))

    return marked.groupBy(F.col("rule_header_id").alias("inc_hdr_id")).agg(
        live("expected_payout").alias("expected_sum"),
        live("forecast_payout").alias("forecast_sum"),
        F.sum(F.when(F.col("value_type") == "VALUE", F.col("expected_payout"))).alias("fixed_sum"),
        F.sum("forecast_payout").alias("all_forecast_sum"),
        F.sum("max_payout").alias("max_sum"),
    )


def master_sums(groups: DataFrame) -> DataFrame:
    """Expected and forecast revenue over the master groups of a header."""
    return (
        groups.where(F.col("master_agreement") == "Y")
        .groupBy("inc_hdr_id")
        .agg(F.sum("expected_base_revenue").alias("master_expected"), F.sum("forecast_base_rev").alias("master_forecast"))
    )


def first_slab_targets(rules: DataFrame, periods: DataFrame, values: DataFrame, products: DataFrame) -> DataFrame:
    """Per header, first-tier target: over the overall product when it has one, else over the split products."""
    first = rule_slabs(
        rules.select("rule_comp_hdr_id", "rule_header_id", "rbd_value"),
        periods.select("rule_comp_period_id", "rule_comp_hdr_id"),
        values.where(F.col("slab_number") == "1").select("rule_comp_period_id", "measure_from"),
    )
    wanted = products.where(F.col("booking_product_code").isin(OVERALL_PRODUCT, *SPLIT_PRODUCTS))
    target = F.col("measure_from") * F.lit(2) / F.lit(100)
    overall = F.col("booking_product_code") == OVERALL_PRODUCT
    return (
        first.join(wanted, F.col("rbd_value") == F.col("rbd_product_id"))
        .groupBy(F.col("rule_header_id").alias("inc_hdr_id"))
        .agg(
            F.sum(F.when(overall, target)).alias("overall_target"),
            F.sum(F.when(~overall, target)).alias("split_target"),
            F.count(F.when(overall, 1)).alias("overall_slabs"),
        )
        .select(
            "inc_hdr_id",
            F.when(F.col("overall_slabs") > 0, F.col("overall_target")).otherwise(F.col("split_target")).alias("tier1_target"),
            F.when(F.col("overall_slabs") > 0, "Y").otherwise("N").alias("has_overall"),
        )
    )


def fixed_fund_groups(models: DataFrame, types: DataFrame) -> DataFrame:
    """Groups with a type other than BASIC."""
    return models.join(types.where(F.col("incentive_type") != "BASIC"), "inc_model_id").select("agreement_group_id")


def uncapped_groups(
    models: DataFrame, types: DataFrame, payouts: DataFrame, rules: DataFrame, periods: DataFrame, values: DataFrame
) -> DataFrame:
    """Groups with a BASIC rule slab that has no upper measure."""
    basic = payout_chain(models, types.where(F.col("incentive_type") == "BASIC"), payouts)
    open_slabs = values.where(F.col("measure_to").isNull())
    return (
        basic.select("agreement_group_id", "payout_type_id")
        .join(rules.select("rule_comp_hdr_id", "payout_type_id"), "payout_type_id")
        .join(periods.select("rule_comp_period_id", "rule_comp_hdr_id"), "rule_comp_hdr_id")
        .join(open_slabs.select("rule_comp_period_id"), "rule_comp_period_id")
        .select("agreement_group_id")
    )


def payout_frequencies(models: DataFrame, types: DataFrame, payouts: DataFrame, codes: DataFrame) -> DataFrame:
    """Per group, description of its payout frequency; of several the lowest."""
    chain = payout_chain(models, types, payouts)
    known = with_lookup(
        chain, codes_of_type(codes, FREQUENCY_CODE_TYPE), {"payment_frequency_type": "code"}, "description", "frequency"
    )
    return known.groupBy("agreement_group_id").agg(F.min("frequency").alias("payout_frequency"))


def miles_summary(deals: DataFrame, miles: DataFrame) -> DataFrame:
    """Balances per header, deal, membership and expiry date.

    Only balances of the given deals are grouped. They are summed per deal, membership and date before they fan out to
    the headers.
    """
    held = deals.select("inc_hdr_id", "deal_code", "membership_number")
    wanted = held.select(F.col("deal_code").alias("track_code"), F.col("membership_number").alias("membership_no")).distinct()
    amounts = ["miles_earned", "miles_redeemed", "miles_balance", "miles_expiry"]
    balances = (
        miles.where(F.col("track_code").isNotNull() & F.col("membership_no").isNotNull())
        .join(wanted, ["track_code", "membership_no"], "left_semi")
        .groupBy("track_code", "membership_no", "miles_expiry_date")
        .agg(*[F.sum(name).alias(name) for name in amounts])
    )
    joined = held.join(
        balances, (held["deal_code"] == balances["track_code"]) & (held["membership_number"] == balances["membership_no"])
    )
    return joined.groupBy("miles_expiry_date", "inc_hdr_id", "deal_code", "membership_number").agg(
        *[F.sum(name).alias(name) for name in amounts]
    )


def first_deals(deals: DataFrame) -> DataFrame:
    """Per header, tier and membership number of its lowest deal."""
    return (
        deals.groupBy("inc_hdr_id")
        .agg(F.min(F.struct("deal_code", "membership_number", "current_tier")).alias("d"))
        .select("inc_hdr_id", F.col("d.current_tier").alias("tier_code"), F.col("d.membership_number").alias("deal_membership"))
    )


def master_tracks(accounts: DataFrame) -> DataFrame:
    """Per header, deal code of its master account; of several the lowest."""
    return (
        accounts.where(F.col("master_agreement") == "Y")
        .groupBy("inc_hdr_id")
        .agg(F.min("deal_code").alias("master_track_code"))
    )


def terminate_reasons(headers: DataFrame, plans: DataFrame, codes: DataFrame) -> DataFrame:
    """Per terminated header, description of the reason its task names."""
    ended = headers.where(F.col("status") == "TERMINATED").select("inc_hdr_id", "activity_id")
    tasks = ended.join(plans, ended["activity_id"] == plans["trx_dtl_id"]).select("inc_hdr_id", "remarks")
    named = with_lookup(tasks, codes, {"remarks": "code"}, "description", "reason", ("code_type",))
    return named.groupBy("inc_hdr_id").agg(F.min("reason").alias("terminatereason"))


def channels(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """Per customer, description of its channel group; of several the lowest."""
    wanted = groups.where(F.col("group_type") == CHANNEL_CODE_TYPE)
    names = codes_of_type(codes, CHANNEL_CODE_TYPE)
    joined = wanted.join(names, wanted["group_code"] == names["code"])
    return joined.groupBy("customer_profile_id").agg(F.min("description").alias("channel_type"))
