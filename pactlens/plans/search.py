"""The paged agreement search.

Steps: (1) filter and join the few tables that decide which rows exist; (2) rank their creation dates from
per-date counts; (3) fetch the rows of the wanted page only, with the page's date range pushed to the
header scan; (4) add every summary and measure to those rows, from children of the page's headers only.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions.conditional import label, nvl, yes_no
from pactlens.functions.dates import within_bounds
from pactlens.operators import filters, joins
from pactlens.operators.exchange import with_rate
from pactlens.operators.joins import left_join_spread
from pactlens.operators.ranking import page_of, rank_of_values
from pactlens.plans import children, measures
from pactlens.plans.children import AllRows, PageScope
from pactlens.schemas import HEADER_COLUMNS, PRODUCT_BASELINE, PRODUCT_LOYALTY_BONUS, SEARCH_COLUMNS, TIER_LABELS
from pactlens.session import materialize
from pactlens.sources.tables import AgreementTables

Scope = AllRows | PageScope

GROUP_COLUMNS = {
    "agreement_group_id": "agreement_group_id",
    "effective_from": "effective_from",
    "effective_to": "effective_to",
    "status": "group_status",
    "country_code": "group_country_code",
    "incentive_currency": "currency",
    "master_agreement": "master_agreement",
    "expected_base_revenue": "expected_base_revenue",
    "add_hdr_id": "group_add_hdr_id",
    "workflow_id": "workflow_id",
    "wf_classifier_code": "wf_classifier_code",
    "approver_user": "approver_user",
}


@dataclass(frozen=True)
class SearchRequest:
    """Parameters of the search; None means "not given"."""

    product_code: str
    customer_type: str
    page_number: int = 1
    page_size: int = 50
    created_from: dt.date | None = None
    created_to: dt.date | None = None
    user_name: str | None = None
    customer_name: str | None = None
    status: str | None = None
    source: str | None = None
    deal_code: str | None = None
    promo_code: str | None = None
    contract_number: str | None = None
    location_type: str | None = None
    country: str | None = None
    pending_with: str | None = None
    cons_status: str | None = None
    inc_from: dt.date | None = None
    inc_to: dt.date | None = None
    inc_city: str | None = None
    soto_ind: str | None = None
    group_status: str | None = None
    payout_frequency: str | None = None
    is_product_level: str | None = None
    currency_code: str | None = None
    soto_inc_country: str | None = None
    soto_location_search: str | None = "Y"
    requested_by_me: str | None = None
    approved_by_me: str | None = None
    incentive_id: int | None = None
    incentive_name: str | None = None
    agreement_status: str | None = None
    as_of: dt.date | None = None

    def opens_result(self) -> bool:
        """Whether the search yields a result set at all."""
        return not self.incentive_id and self.product_code is not None and (self.is_product_level or "N") == "N"


def header_candidates(tables: AgreementTables, request: SearchRequest) -> DataFrame:
    """Headers that pass every test on the header alone; all of it column-to-literal, so it reaches the scan."""
    column = F.col
    return tables.inc_hdr.where(
        filters.all_of(
            filters.equals(column("sales_product_code"), request.product_code),
            filters.equals(column("customer_type"), request.customer_type),
            filters.created_between(column("created_date"), request.created_from, request.created_to),
            filters.name_contains(column("inc_name"), request.incentive_name),
            filters.in_list(column("status"), request.status),
            filters.optional_strict(column("source_type"), request.source),
            filters.optional_keep_null(column("master_contract_number"), request.contract_number),
            filters.optional_keep_null(column("promo_code"), request.promo_code),
            filters.optional_keep_null(column("incentive_city"), request.inc_city, "#"),
            filters.pending_with(column("task_pending_with"), request.pending_with),
            filters.period_matches(
                column("sales_product_code"), column("effective_from"), column("effective_to"), request.inc_from, request.inc_to
            ),
            filters.requested_by(column("created_by"), request.requested_by_me, request.user_name),
        )
    )


def matching_rows(tables: AgreementTables, request: SearchRequest, candidates: DataFrame) -> DataFrame:
    """Rows of the result before ranking: candidate header x group x balances x open addenda."""
    headers = candidates
    if request.deal_code:
        deals = tables.inc_associated_accounts.where(F.col("deal_code") == request.deal_code)
        headers = joins.having(headers, deals, "inc_hdr_id")
    if request.approved_by_me == "Y":
        mine = joins.approved_headers(tables.wf_approval_history, tables.inc_agreement_group, request.user_name)
        headers = joins.having(headers, mine, "inc_hdr_id")
    elif request.approved_by_me is not None:
        headers = headers.where(F.lit(False))

    customers = tables.customer_profile.where(
        filters.all_of(filters.name_contains_if_given(F.col("customer_name"), request.customer_name))
    ).select("customer_profile_id", "customer_name", "customer_code", "industry_sector")

    groups = tables.inc_agreement_group.where(
        filters.all_of(
            filters.master_switch(F.col("master_agreement"), request.soto_ind),
            filters.in_list(F.col("status"), request.group_status),
            filters.no_addendum_unless_soto(F.col("add_hdr_id"), request.soto_ind),
        )
    )
    if request.payout_frequency and request.payout_frequency != "ALL":
        paid = joins.payout_chain(tables.inc_models, tables.inc_types, tables.inc_payout_types)
        paid = paid.where(F.col("payment_frequency_type") == request.payout_frequency)
        groups = joins.having(groups, paid, "agreement_group_id")
    groups = groups.select(F.col("inc_hdr_id"), *[F.col(old).alias(new) for old, new in GROUP_COLUMNS.items()])

    headers = headers.select(
        *[
            F.col(name).alias({"effective_from": "inc_from", "effective_to": "inc_to"}.get(name, name))
            for name in HEADER_COLUMNS
        ]
    )
    rows = headers.join(customers, "customer_profile_id").join(groups, "inc_hdr_id")
    rows = rows.where(
        filters.all_of(
            filters.home_country_unless_soto(F.col("group_country_code"), F.col("incentive_country"), request.soto_ind),
            filters.soto_country(
                F.col("group_country_code"),
                F.col("incentive_country"),
                F.col("master_agreement"),
                request.soto_ind,
                request.soto_location_search,
                request.country,
                request.soto_inc_country,
            ),
        )
    )
    rows = joins.location_scope(rows, tables.location_hierarchy, request.location_type, request.country, request.soto_ind)

    ids = candidates.select("inc_hdr_id")
    deals = tables.offer_deal_codes.join(ids, "inc_hdr_id", "left_semi")
    miles = children.miles_summary(deals, tables.miles_info)
    miles = miles.select(
        F.col("inc_hdr_id").alias("miles_hdr_id"), "miles_earned", "miles_redeemed", "miles_balance", "miles_expiry", "miles_expiry_date"
    )
    addenda = children.open_rule_addenda(tables.inc_add_hdr.join(ids, "inc_hdr_id", "left_semi")).select(
        F.col("inc_hdr_id").alias("open_hdr_id"), F.col("cons_status").alias("open_cons_status"), F.col("add_hdr_id_list").alias("add_hdr_id")
    )
    rows = rows.join(addenda, rows["inc_hdr_id"] == addenda["open_hdr_id"], "left")
    rows = rows.where(
        filters.all_of(filters.optional_two_source(F.col("cons_status"), F.col("open_cons_status"), request.cons_status))
    )
    rows = rows.join(miles, rows["inc_hdr_id"] == miles["miles_hdr_id"], "left")
    return rows.drop("open_hdr_id", "open_cons_status", "miles_hdr_id")


def date_ranks(tables: AgreementTables, request: SearchRequest) -> DataFrame:
    """Rank index of a request: rows and rank per creation date, whatever the page. The one pass that counts matching rows."""
    rows = matching_rows(tables, request, header_candidates(tables, request))
    return materialize(rank_of_values(rows, "created_date"), "rank-index")


def page_rows(tables: AgreementTables, request: SearchRequest, ranks: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted page with their rank, written once.

    The first pass only counts rows per creation date; with `ranks`, a rank index kept from another page of the same
    request, there is none. The page's dates are at most `page_size` rows; the second pass reads the headers created
    between the first and last of them, and writes those before it joins, so that the joins of a small page start from a
    small side of known size.
    """
    candidates = header_candidates(tables, request)
    if ranks is None:
        ranks = rank_of_values(matching_rows(tables, request, candidates), "created_date")
    on_page = page_of(F.col("rnk"), request.page_number, request.page_size)
    dates = materialize(ranks.where(on_page).select("rank_key", "rnk"), "page-dates")
    created = F.col("created_date")
    in_range = within_bounds(created, dates, "rank_key")
    near = materialize(candidates.where(in_range), "page-headers")
    rows = matching_rows(tables, request, near).join(dates, created == F.col("rank_key")).drop("rank_key")
    return materialize(rows, "page-rows")


def add_loyalty_measures(rows: DataFrame, tables: AgreementTables, scope: Scope, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Amounts and ratios of the loyalty bonus product; `rows` has fx_rate, `rules` and `groups` are those of its headers."""
    headline = joins.headline_groups(groups).select(
        "inc_hdr_id",
        F.col("expected_base_revenue").alias("headline_expected"),
        F.col("forecast_base_rev").alias("headline_forecast"),
        F.lit(True).alias("has_headline"),
    )
    parents = joins.headline_groups(scope.of(tables.inc_agreement_group, "inc_hdr_id", "parent_inc_id")).select(
        F.col("inc_hdr_id").alias("parent_hdr_id"), F.col("forecast_base_rev").alias("parent_forecast"), F.lit(True).alias("parent_has_group")
    )
    cancelled = tables.inc_add_hdr.where(F.col("status") == "CANCELLED").select("add_hdr_id", "status")
    sums = children.payout_sums(rules, scope.chained(cancelled, rules, "add_hdr_id"))
    rows = rows.join(headline, "inc_hdr_id", "left").join(sums, "inc_hdr_id", "left")
    rows = left_join_spread(rows, parents, "parent_inc_id", "parent_hdr_id", "inc_hdr_id")
    return measures.add_ratios(measures.add_amounts(rows))


def flag_frame(matches: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with a marker column."""
    return matches.select(key).distinct().withColumn(name, F.lit(True))


def attach(keys: DataFrame, key: str, frames: list[DataFrame]) -> DataFrame:
    """Distinct keys with the columns of frames that have one row per key."""
    facts = keys.select(key).distinct()
    for frame in frames:
        facts = facts.join(frame, key, "left")
    return facts


@dataclass(frozen=True)
class RuleChain:
    """Rules, periods, slabs and what-ifs of a page, each table read once; header and group facts share them.

    `rules` holds those of the page's headers (of_header) and those below its groups' payout types (of_group).
    """

    rules: DataFrame
    periods: DataFrame
    values: DataFrame
    whatifs: DataFrame
    models: DataFrame | None
    types: DataFrame | None
    payouts: DataFrame | None

    @property
    def of_headers(self) -> DataFrame:
        return self.rules.where("of_header")


def rule_chain(tables: AgreementTables, scope: PageScope, with_groups: bool) -> RuleChain:
    """The page's part of the two chains that end in slabs: by header, and by group where `with_groups`."""
    models = types = payouts = None
    wanted = {"of_header": ("rule_header_id", scope.page, "inc_hdr_id")}
    if with_groups:
        models = scope.start(tables.inc_models, "agreement_group_id", "agreement_group_id")
        types = scope.chained(tables.inc_types, models, "inc_model_id")
        payouts = scope.chained(tables.inc_payout_types, types, "inc_type_id")
        wanted["of_group"] = ("payout_type_id", payouts, "payout_type_id")
    rules = scope.flagged(tables.inc_rule_comp_hdr, wanted)
    periods = scope.chained(tables.inc_rule_comp_period, rules, "rule_comp_hdr_id")
    values = scope.chained(tables.inc_rule_comp_value, periods, "rule_comp_period_id")
    whatifs = scope.chained(tables.inc_rule_comp_whatif, rules, "rule_comp_hdr_id")
    return RuleChain(rules, periods, values, whatifs, models, types, payouts)


def header_facts(tables: AgreementTables, scope: PageScope, chain: RuleChain, groups: DataFrame) -> DataFrame:
    """One row per header of the page: lists, flags and sums of its children; `groups` are those of its headers."""

    def of_page(child: DataFrame) -> DataFrame:
        return scope.of(child, "inc_hdr_id", "inc_hdr_id")

    page, rules = scope.page, chain.of_headers
    exceptions = of_page(tables.inc_exceptions)
    spans = page.select("inc_hdr_id", F.col("inc_from").alias("effective_from"), F.col("inc_to").alias("effective_to")).distinct()
    frames = [
        children.addendum_lists(of_page(tables.inc_add_hdr)),
        children.exception_lists(exceptions),
        children.exception_descriptions(exceptions, tables.mst_code_dtl),
        children.first_deals(of_page(tables.offer_deal_codes)),
        children.master_tracks(of_page(tables.inc_associated_accounts)),
        children.terminate_reasons(page.select("inc_hdr_id", "status", "activity_id"), tables.svc_trx_task_plan, tables.mst_code_dtl),
        children.first_slab_targets(rules, chain.periods, chain.values, tables.inc_rbd_products),
        flag_frame(of_page(tables.inc_process_dtl), "inc_hdr_id", "is_approved"),
        flag_frame(of_page(tables.inc_ticketing_agents), "inc_hdr_id", "is_ticketed"),
        flag_frame(joins.shrinking_headers(spans, rules, chain.whatifs), "inc_hdr_id", "is_shrinking"),
        children.master_sums(groups),
    ]
    return attach(page, "inc_hdr_id", frames)


def group_facts(tables: AgreementTables, scope: PageScope, chain: RuleChain) -> DataFrame:
    """One row per group of the page: payout frequency and plan flags."""
    rules = chain.rules.where("of_group")
    uncapped = children.uncapped_groups(chain.models, chain.types, chain.payouts, rules, chain.periods, chain.values)
    frames = [
        children.payout_frequencies(chain.models, chain.types, chain.payouts, tables.mst_code_dtl),
        flag_frame(children.fixed_fund_groups(chain.models, chain.types), "agreement_group_id", "is_fixed"),
        flag_frame(uncapped, "agreement_group_id", "is_uncapped"),
    ]
    return attach(scope.page, "agreement_group_id", frames)


def customer_facts(tables: AgreementTables, scope: PageScope) -> DataFrame:
    """One row per customer of the page: address, contacts and channel."""

    def of_page(child: DataFrame) -> DataFrame:
        return scope.of(child, "customer_profile_id", "customer_profile_id")

    addresses = joins.location_address(of_page(tables.customer_address), tables.mst_city, tables.mst_country)
    contacts = scope.start(tables.contact_details, "customer_profile_id", "customer_profile_id")
    frames = [
        joins.with_city_code(addresses, tables.mst_city, "address_city_name", "address_country", "incentive_city_code"),
        joins.contact_people(contacts, tables.contact_communication),
        children.channels(of_page(tables.agent_custom_grp), tables.mst_code_dtl),
    ]
    return attach(scope.page, "customer_profile_id", frames)


class PagedSearch:
    """Pages of one request over unchanged tables. Its rank index is written with the first page and serves all others."""

    def __init__(self, tables: AgreementTables, request: SearchRequest):
        self.tables, self.request = tables, request
        self._ranks: DataFrame | None = None

    def page(self, number: int) -> DataFrame:
        request = replace(self.request, page_number=number)
        if self._ranks is None and request.opens_result():
            self._ranks = date_ranks(self.tables, request)
        return search_agreements(self.tables, request, self._ranks)


def no_result(tables: AgreementTables, request: SearchRequest) -> DataFrame:
    """The columns of a result without rows, from the search's own plan; no table is read."""
    nothing = AgreementTables(tables.spark, lambda name: getattr(tables, name).where(F.lit(False)))
    plain = replace(request, incentive_id=None, is_product_level="N", product_code=request.product_code or "")
    return search_agreements(nothing, plain)


def search_agreements(tables: AgreementTables, request: SearchRequest, ranks: DataFrame | None = None) -> DataFrame:
    """One page of agreements, newest first by rank, in the columns of SEARCH_COLUMNS; `ranks` as for `page_rows`.

    A request that asks for no result set (an explicit agreement id, or product level) gives no rows.
    """
    if not request.opens_result():
        return no_result(tables, request)
    as_of = request.as_of or dt.date.today()
    page = page_rows(tables, request, ranks)
    scope = PageScope(page)
    plb = request.product_code == PRODUCT_LOYALTY_BONUS
    chain = rule_chain(tables, scope, with_groups=plb)
    groups = scope.start(tables.inc_agreement_group, "inc_hdr_id", "inc_hdr_id")
    status = measures.derived_status(request.product_code, as_of)
    rows = page.withColumn("agreement_new_status", status)
    rows = rows.where(filters.all_of(filters.in_list(F.col("agreement_new_status"), request.agreement_status)))

    if plb or request.product_code == PRODUCT_BASELINE:
        rows = with_rate(rows, tables.fx_rates, F.col("currency"), F.col("inc_from"), request.currency_code or "")
    else:
        rows = rows.withColumn("fx_rate", F.lit(None).cast("decimal(9,3)"))
    if plb:
        rows = measures.round_amounts(add_loyalty_measures(rows, tables, scope, chain.of_headers, groups))
        rows = rows.join(group_facts(tables, scope, chain), "agreement_group_id", "left")
    else:
        rows = measures.no_loyalty_measures(rows)
    rows = rows.join(header_facts(tables, scope, chain, groups), "inc_hdr_id", "left")
    rows = rows.join(customer_facts(tables, scope), "customer_profile_id", "left")
    rows = joins.with_lookup(rows, tables.mst_code_dtl, {"industry_sector": "code"}, "description", "industry_description", ("code_type",))
    rows = joins.with_lookup(
        rows, tables.mst_country, {"group_country_code": "country_code"}, "country_name", "group_country_code_desc"
    )
    rows = measures.add_baseline(measures.with_pending_label(rows, tables.um_role_master))

    nothing = F.lit(None).cast("string")
    computed = {
        "soto_agreement": nvl(F.col("soto_agreement"), "N"),
        "incentive_city": F.col("address_city_name"),
        "incentive_country": F.col("address_country_name"),
        "incentive_country_desc": F.col("address_country_name"),
        "inc_city_code": F.col("address_city_name"),
        "soto_master": nvl(F.col("master_agreement"), "Y"),
        "membership_number": F.col("deal_membership"),
        "miles_eligible": F.lit(0),
        "miles_non_eligible": F.lit(0),
        "total_revenue": F.lit(0),
        "current_tier": label(F.col("tier_code"), TIER_LABELS),
        "retro_miles": nothing,
        "retro_period": nothing,
        "has_approval": yes_no(F.col("is_approved")),
        "tkt_agent_exists": yes_no(F.col("is_ticketed")),
        "negative_growth": yes_no(F.col("is_shrinking")),
        "is_super_plb": measures.is_super_agreement(request.product_code),
        "payout_frequency": F.col("payout_frequency") if plb else nothing,
        "is_fixed_fund": yes_no(F.col("is_fixed")) if plb else nothing,
        "is_all_prodcut_cap": yes_no(F.col("is_uncapped").isNull()) if plb else nothing,
        "channel_type": measures.channel_label(request.product_code),
    }
    return rows.select(*[computed[name].alias(name) if name in computed else F.col(name) for name in SEARCH_COLUMNS])
