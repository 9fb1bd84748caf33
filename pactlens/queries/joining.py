"""Joins of the search and of the ad-hoc lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens.operators import joins
from pactlens.operators.aggregates import with_flag
from pactlens.operators.exchange import with_rate
from pactlens.plans import children, lookups
from pactlens.queries.fragments import ADDRESS_CTE, ANY_CODE_CTE, FX_CTE, HEADLINE_CTE, rate_sql
from pactlens.queries.registry import big, day, num, query, stamp


@query(
    "join_inner_multi",
    f"""SELECT a.address_type, {num('g.expected_base_revenue')}, h.inc_hdr_id, m.communication_value, m.communication_type, d.contact_type,
        c.customer_name, a.address_line1, a.city, h.status, h.inc_name, o.deal_code
    FROM offer_deal_codes o
    JOIN account_subscriptions s ON s.account_subscription_id = o.account_subscription_id
    JOIN inc_hdr h ON h.inc_hdr_id = o.inc_hdr_id
    JOIN customer_profile c ON c.customer_profile_id = h.customer_profile_id
    JOIN customer_address a ON a.customer_profile_id = c.customer_profile_id
    JOIN contact_details d ON d.customer_profile_id = c.customer_profile_id
    JOIN contact_communication m ON m.contact_detail_id = d.contact_detail_id
    JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id
    WHERE o.deal_code IN ('D51', 'D7', 'D60') AND d.contact_type = 'SMEADMIN'""",
)
def join_inner_multi(t):
    return lookups.deal_overview(t, ["D51", "D7", "D60"], "SMEADMIN")


@query(
    "join_inner_sorted",
    """SELECT i.inc_hdr_id, c.customer_name, i.agent_profile_id FROM inc_ticketing_agents i
    JOIN customer_profile c ON c.customer_profile_id = i.agent_profile_id WHERE i.inc_hdr_id BETWEEN 100 AND 400 ORDER BY 1 DESC""",
)
def join_inner_sorted(t):
    return lookups.ticketing_agents(t, F.col("inc_hdr_id").between(100, 400))


@query(
    "join_inner_implicit",
    """SELECT h.inc_hdr_id, c.customer_name, g.agreement_group_id, g.status AS group_status
    FROM inc_hdr h, customer_profile c, inc_agreement_group g
    WHERE g.inc_hdr_id = h.inc_hdr_id AND c.customer_profile_id = h.customer_profile_id""",
)
def join_inner_implicit(t):
    headers = t.inc_hdr.select("inc_hdr_id", "customer_profile_id")
    customers = t.customer_profile.select("customer_profile_id", "customer_name")
    groups = t.inc_agreement_group.select("inc_hdr_id", "agreement_group_id", F.col("status").alias("group_status"))
    named = joins.join_hot(headers, customers, "customer_profile_id").drop("customer_profile_id")
    return joins.join_hot(groups, named, "inc_hdr_id")


@query(
    "join_left_outer",
    """SELECT h.inc_hdr_id, a.add_hdr_id, a.cons_status FROM inc_hdr h LEFT JOIN (
        SELECT inc_hdr_id, cons_status, string_agg(CAST(add_hdr_id AS VARCHAR), ',' ORDER BY add_hdr_id) AS add_hdr_id FROM inc_add_hdr
        WHERE add_type = 'RULES' AND cons_status <> 'COMPLETED' AND status <> 'CANCELLED'
        GROUP BY inc_hdr_id, cons_status, CASE WHEN task_pending_with = 'NA' THEN 'Not Applicable' ELSE task_pending_with END) a
    ON a.inc_hdr_id = h.inc_hdr_id""",
)
def join_left_outer(t):
    addenda = children.open_rule_addenda(t.inc_add_hdr).select(
        "inc_hdr_id", "cons_status", F.col("add_hdr_id_list").alias("add_hdr_id")
    )
    return joins.left_join_hot(t.inc_hdr.select("inc_hdr_id"), addenda, "inc_hdr_id")


@query("join_left_lookup", f"WITH {ADDRESS_CTE} SELECT * FROM addr")
def join_left_lookup(t):
    return joins.location_address(t.customer_address, t.mst_city, t.mst_country)


@query(
    "join_composite_key",
    f"""SELECT d.inc_hdr_id, d.deal_code, {day('m.miles_expiry_date')}, {num('m.miles_earned')}
    FROM offer_deal_codes d JOIN miles_info m ON m.track_code = d.deal_code AND m.membership_no = d.membership_number""",
)
def join_composite_key(t):
    deals, miles = t.offer_deal_codes, t.miles_info
    both = (deals["deal_code"] == miles["track_code"]) & (deals["membership_number"] == miles["membership_no"])
    return deals.join(miles, both).select("inc_hdr_id", "deal_code", "miles_expiry_date", "miles_earned")


@query(
    "join_self_parent",
    f"""WITH {HEADLINE_CTE} SELECT h.inc_hdr_id, h.parent_inc_id, {num('p.forecast_base_rev', 'parent_forecast')}
    FROM inc_hdr h LEFT JOIN headline p ON p.inc_hdr_id = h.parent_inc_id""",
)
def join_self_parent(t):
    return joins.header_with_parent_group(t.inc_hdr.select("inc_hdr_id", "parent_inc_id"), t.inc_agreement_group)


@query(
    "join_chain_exists",
    """SELECT g.agreement_group_id FROM inc_agreement_group g WHERE EXISTS (SELECT 1 FROM inc_models m
        JOIN inc_types y ON y.inc_model_id = m.inc_model_id JOIN inc_payout_types p ON p.inc_type_id = y.inc_type_id
        WHERE m.agreement_group_id = g.agreement_group_id AND p.payment_frequency_type = 'QTR')""",
)
def join_chain_exists(t):
    paid = joins.payout_chain(t.inc_models, t.inc_types, t.inc_payout_types).where(F.col("payment_frequency_type") == "QTR")
    return joins.having(t.inc_agreement_group.select("agreement_group_id"), paid, "agreement_group_id")


@query(
    "semi_join_exists",
    """SELECT h.inc_hdr_id, h.inc_name FROM inc_hdr h WHERE EXISTS (SELECT 1 FROM inc_associated_accounts a
        WHERE a.inc_hdr_id = h.inc_hdr_id AND a.deal_code = 'D12')""",
)
def semi_join_exists(t):
    deals = t.inc_associated_accounts.where(F.col("deal_code") == "D12")
    return joins.having(t.inc_hdr.select("inc_hdr_id", "inc_name"), deals, "inc_hdr_id")


@query(
    "existence_join_or",
    """SELECT h.inc_hdr_id, h.created_by FROM inc_hdr h WHERE h.is_reset = 'Y' OR EXISTS (
        SELECT 1 FROM wf_approval_history w JOIN inc_agreement_group g ON w.wf_request_id = g.workflow_id
        WHERE g.inc_hdr_id = h.inc_hdr_id AND w.actioned_by = 'U7' AND w.action_code = 'APPROVE' AND w.status = 'APPROVED')""",
)
def existence_join_or(t):
    approved = joins.approved_headers(t.wf_approval_history, t.inc_agreement_group, "U7")
    headers = with_flag(t.inc_hdr.select("inc_hdr_id", "created_by", "is_reset"), approved, "inc_hdr_id", "approved_by_me")
    return headers.where((F.col("is_reset") == "Y") | (F.col("approved_by_me") == "Y")).select("inc_hdr_id", "created_by")


@query(
    "semi_join_in",
    """SELECT lead_id, status FROM lead_header WHERE customer_profile_id IN (
        SELECT customer_profile_id FROM customer_profile WHERE customer_code IN ('CC17', 'CC4', 'CC93'))""",
)
def semi_join_in(t):
    wanted = t.customer_profile.where(F.col("customer_code").isin("CC17", "CC4", "CC93"))
    return joins.having(t.lead_header, wanted, "customer_profile_id").select("lead_id", "status")


@query(
    "theta_semi_join",
    f"""SELECT h.inc_hdr_id, {stamp('h.effective_from')} FROM inc_hdr h WHERE EXISTS (SELECT 1 FROM inc_rule_comp_hdr r
        JOIN inc_rule_comp_whatif w ON w.rule_comp_hdr_id = r.rule_comp_hdr_id WHERE r.rule_header_id = h.inc_hdr_id
        AND w.period_from >= h.effective_from AND w.period_to <= h.effective_to AND w.growth_perc < 0)""",
)
def theta_semi_join(t):
    headers = t.inc_hdr.select("inc_hdr_id", "effective_from", "effective_to")
    shrinking = joins.shrinking_headers(headers, t.inc_rule_comp_hdr, t.inc_rule_comp_whatif)
    return joins.having(headers, shrinking, "inc_hdr_id").select("inc_hdr_id", "effective_from")


@query(
    "join_ci_composite",
    f"""WITH {ADDRESS_CTE} SELECT a.customer_profile_id, (SELECT min(c.city_code) FROM mst_city c
        WHERE upper(c.city_name) = upper(a.address_city_name) AND upper(c.country_code) = upper(a.address_country)) AS city_code
    FROM addr a""",
)
def join_ci_composite(t):
    addresses = joins.location_address(t.customer_address, t.mst_city, t.mst_country)
    coded = joins.with_city_code(addresses, t.mst_city, "address_city_name", "address_country", "city_code")
    return coded.select("customer_profile_id", "city_code")


@query(
    "join_csv_expand",
    """SELECT h.inc_hdr_id, (SELECT string_agg(r.role_name, ',' ORDER BY r.role_code, r.role_name) FROM um_role_master r
        WHERE list_contains(string_split(h.task_pending_with, ','), r.role_code)) AS role_names FROM inc_hdr h""",
)
def join_csv_expand(t):
    headers = t.inc_hdr.select("inc_hdr_id", "task_pending_with")
    named = joins.names_of_code_lists(
        headers, "task_pending_with", t.um_role_master, "role_code", "role_name", "role_names", ",", ("role_code", "role_name")
    )
    return named.select("inc_hdr_id", "role_names")


@query(
    "join_code_lookup",
    f"""WITH {ANY_CODE_CTE} SELECT p.payout_type_id, f.description AS payout_frequency, NULL::VARCHAR AS industry FROM inc_payout_types p
        LEFT JOIN (SELECT code, description FROM mst_code_dtl WHERE code_type = 'INCPAYFREQ') f ON f.code = p.payment_frequency_type
    UNION ALL SELECT c.customer_profile_id, NULL, a.description FROM customer_profile c LEFT JOIN any_code a ON a.code = c.industry_sector""",
)
def join_code_lookup(t):
    frequencies = joins.codes_of_type(t.mst_code_dtl, "INCPAYFREQ")
    payouts = joins.with_lookup(t.inc_payout_types, frequencies, {"payment_frequency_type": "code"}, "description", "payout_frequency")
    customers = joins.with_lookup(
        t.customer_profile, t.mst_code_dtl, {"industry_sector": "code"}, "description", "industry", ("code_type",)
    )
    return payouts.select("payout_type_id", "payout_frequency", F.lit(None).cast("string").alias("industry")).unionByName(
        customers.select(
            F.col("customer_profile_id").alias("payout_type_id"), F.lit(None).cast("string").alias("payout_frequency"), "industry"
        )
    )


@query(
    "join_role_bridge",
    f"""SELECT u.user_id, u.user_name, {big('r.role_id')}, r.role_code FROM um_user_master u
    JOIN um_user_privilege p ON p.user_id = u.user_id JOIN um_role_master r ON r.role_id = p.role_id
    WHERE u.active = 'Y' AND p.active = 'Y' AND r.active = 'Y'""",
)
def join_role_bridge(t):
    return joins.user_roles(t.um_user_master, t.um_user_privilege, t.um_role_master).drop("role_name")


@query(
    "join_fx_rate",
    f"""WITH {FX_CTE} SELECT g.agreement_group_id, {num(rate_sql('g.incentive_currency', 'h.effective_from'), 'rate')},
        CAST(g.expected_base_revenue * {rate_sql('g.incentive_currency', 'h.effective_from')} AS DOUBLE) AS converted
    FROM inc_agreement_group g JOIN inc_hdr h ON h.inc_hdr_id = g.inc_hdr_id""",
)
def join_fx_rate(t):
    groups = t.inc_agreement_group.select("inc_hdr_id", "agreement_group_id", "incentive_currency", "expected_base_revenue")
    dated = groups.join(t.inc_hdr.select("inc_hdr_id", "effective_from"), "inc_hdr_id")
    rated = with_rate(dated, t.fx_rates, F.col("incentive_currency"), F.col("effective_from"), "C0")
    return rated.select(
        "agreement_group_id", F.col("fx_rate").alias("rate"), (F.col("expected_base_revenue") * F.col("fx_rate")).alias("converted")
    )
