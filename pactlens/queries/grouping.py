"""Aggregations, rank, pages, top-1 and sort."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pactlens.operators import aggregates, joins, ranking
from pactlens.operators.exchange import with_rate
from pactlens.plans import children
from pactlens.plans.measures import derived_status
from pactlens.queries.fragments import FX_CTE, derived_status_sql, rate_sql
from pactlens.queries.registry import day, num, query, stamp

MILES_SUMS = ", ".join(num(f"sum(m.{name})", name) for name in ("miles_earned", "miles_redeemed", "miles_balance", "miles_expiry"))


@query(
    "agg_group_sum",
    f"""SELECT {day('m.miles_expiry_date')}, d.inc_hdr_id, d.deal_code, d.membership_number, {MILES_SUMS}
    FROM offer_deal_codes d JOIN inc_hdr h ON h.inc_hdr_id = d.inc_hdr_id
    JOIN miles_info m ON m.track_code = d.deal_code AND m.membership_no = d.membership_number
    GROUP BY m.miles_expiry_date, d.inc_hdr_id, d.deal_code, d.membership_number""",
)
def agg_group_sum(t):
    deals = t.offer_deal_codes.join(t.inc_hdr.select("inc_hdr_id"), "inc_hdr_id")
    return children.miles_summary(deals, t.miles_info)


@query(
    "agg_group_expr_key",
    """SELECT inc_hdr_id, cons_status, CASE WHEN task_pending_with = 'NA' THEN 'Not Applicable' ELSE task_pending_with END AS task_pending_with,
        string_agg(CAST(add_hdr_id AS VARCHAR), ',' ORDER BY add_hdr_id) AS add_hdr_id_list
    FROM inc_add_hdr WHERE add_type = 'RULES' AND cons_status <> 'COMPLETED' AND status <> 'CANCELLED' GROUP BY 1, 2, 3""",
)
def agg_group_expr_key(t):
    return children.open_rule_addenda(t.inc_add_hdr)


ADDENDUM_LISTS_SQL = ", ".join(
    f"string_agg(CAST({column} AS VARCHAR), '~' ORDER BY add_name, add_hdr_id) AS {name}"
    for name, column in {
        "addendum": "add_name",
        "addendum_type": "add_type",
        "addendum_status": "status",
        "addendum_id": "add_hdr_id",
    }.items()
)


@query("agg_listagg_ordered", f"SELECT inc_hdr_id, {ADDENDUM_LISTS_SQL} FROM inc_add_hdr GROUP BY inc_hdr_id")
def agg_listagg_ordered(t):
    return children.addendum_lists(t.inc_add_hdr).drop("inc_add_cnt")


EXCEPTION_LISTS_SQL = """string_agg(exception_code, '~' ORDER BY exception_code, inc_exception_id) AS exception_code,
    string_agg(exception_type, '~' ORDER BY exception_code, inc_exception_id) AS exception_type,
    string_agg(CASE WHEN add_hdr_id IS NULL THEN 'MAIN' ELSE 'ADD' END, '~' ORDER BY exception_code, inc_exception_id) AS exception_desc_type"""


@query("agg_listagg_two_keys", f"SELECT inc_hdr_id, {EXCEPTION_LISTS_SQL} FROM inc_exceptions GROUP BY inc_hdr_id")
def agg_listagg_two_keys(t):
    return children.exception_lists(t.inc_exceptions)


@query(
    "agg_listagg_codes",
    """WITH used AS (SELECT DISTINCT inc_hdr_id, exception_code FROM inc_exceptions)
    SELECT u.inc_hdr_id, string_agg(c.description, '~' ORDER BY c.code, c.code_type, c.description) AS exception_desc
    FROM used u JOIN mst_code_dtl c ON c.code = u.exception_code WHERE c.code_type IN ('INC_GLD_RL', 'INC_EXP') GROUP BY u.inc_hdr_id""",
)
def agg_listagg_codes(t):
    return children.exception_descriptions(t.inc_exceptions, t.mst_code_dtl)


@query(
    "agg_stragg",
    """SELECT p.user_id, string_agg(r.role_name, ',' ORDER BY r.role_code, r.role_name) AS role_names
    FROM (SELECT DISTINCT user_id, role_id FROM um_user_privilege) p JOIN um_role_master r ON r.role_id = p.role_id GROUP BY p.user_id""",
)
def agg_stragg(t):
    held = t.um_user_privilege.select("user_id", "role_id").distinct().join(t.um_role_master, "role_id")
    order = [F.col("role_code"), F.col("role_name")]
    return aggregates.ordered_lists(held, ["user_id"], {"role_names": (F.col("role_name"), order, ",")})


@query(
    "agg_count_correlated",
    """SELECT h.inc_hdr_id, (SELECT cnt FROM (SELECT a.inc_hdr_id, CAST(count(1) AS BIGINT) AS cnt FROM inc_add_hdr a
        GROUP BY a.inc_hdr_id) x WHERE x.inc_hdr_id = h.inc_hdr_id) AS inc_add_cnt FROM inc_hdr h""",
)
def agg_count_correlated(t):
    counts = t.inc_add_hdr.groupBy("inc_hdr_id").agg(F.count(F.lit(1)).alias("inc_add_cnt"))
    return t.inc_hdr.select("inc_hdr_id").join(counts, "inc_hdr_id", "left")


@query(
    "agg_exists_flag",
    """SELECT h.inc_hdr_id,
        CASE WHEN EXISTS (SELECT 1 FROM inc_ticketing_agents a WHERE a.inc_hdr_id = h.inc_hdr_id) THEN 'Y' ELSE 'N' END AS tkt_agent_exists,
        CASE WHEN EXISTS (SELECT 1 FROM inc_rule_comp_hdr r JOIN inc_rule_comp_period p ON p.rule_comp_hdr_id = r.rule_comp_hdr_id
            JOIN inc_rule_comp_value v ON v.rule_comp_period_id = p.rule_comp_period_id
            JOIN inc_rbd_products b ON b.rbd_product_id = r.rbd_value
            WHERE r.rule_header_id = h.inc_hdr_id AND v.slab_number = '1' AND b.booking_product_code = 'PLBOVERALL')
            THEN 'Y' ELSE 'N' END AS has_overall
    FROM inc_hdr h""",
)
def agg_exists_flag(t):
    headers = aggregates.with_flag(t.inc_hdr.select("inc_hdr_id"), t.inc_ticketing_agents, "inc_hdr_id", "tkt_agent_exists")
    targets = children.first_slab_targets(t.inc_rule_comp_hdr, t.inc_rule_comp_period, t.inc_rule_comp_value, t.inc_rbd_products)
    overall = targets.where(F.col("has_overall") == "Y")
    return aggregates.with_flag(headers, overall.select("inc_hdr_id"), "inc_hdr_id", "has_overall")


# Groups with a slab that has no upper end below a BASIC type: keys carried from the slab up to its group.
UNCAPPED_SQL = """g.agreement_group_id IN (
        WITH endless AS (SELECT DISTINCT rule_comp_period_id FROM inc_rule_comp_value WHERE measure_to IS NULL),
        rules AS (SELECT DISTINCT payout_type_id FROM inc_rule_comp_hdr
            WHERE rule_comp_hdr_id IN (SELECT rule_comp_hdr_id FROM inc_rule_comp_period SEMI JOIN endless USING (rule_comp_period_id))),
        kinds AS (SELECT inc_type_id FROM inc_payout_types SEMI JOIN rules USING (payout_type_id)),
        basic AS (SELECT inc_model_id FROM inc_types SEMI JOIN kinds USING (inc_type_id) WHERE incentive_type = 'BASIC')
        SELECT agreement_group_id FROM inc_models SEMI JOIN basic USING (inc_model_id) WHERE agreement_group_id IS NOT NULL)"""


@query(
    "agg_inverse_flag",
    f"""SELECT g.agreement_group_id, CASE WHEN {UNCAPPED_SQL} THEN 'N' ELSE 'Y' END AS is_all_prodcut_cap FROM inc_agreement_group g""",
)
def agg_inverse_flag(t):
    uncapped = children.uncapped_groups(
        t.inc_models, t.inc_types, t.inc_payout_types, t.inc_rule_comp_hdr, t.inc_rule_comp_period, t.inc_rule_comp_value
    )
    groups = t.inc_agreement_group.select("agreement_group_id")
    return aggregates.with_flag(groups, uncapped, "agreement_group_id", "is_all_prodcut_cap", present="N", absent="Y")


@query(
    "agg_sum_nvl",
    f"""WITH {FX_CTE}, rated AS (SELECT g.inc_hdr_id, g.expected_base_revenue * {rate_sql('g.incentive_currency', 'h.effective_from')} AS amount
        FROM inc_agreement_group g JOIN inc_hdr h ON h.inc_hdr_id = g.inc_hdr_id)
    SELECT h.inc_hdr_id, CAST(coalesce((SELECT sum(amount) FROM rated r WHERE r.inc_hdr_id = h.inc_hdr_id), 0) AS DOUBLE) AS expected
    FROM inc_hdr h""",
)
def agg_sum_nvl(t):
    headers = t.inc_hdr.select("inc_hdr_id", "effective_from")
    groups = t.inc_agreement_group.select("inc_hdr_id", "incentive_currency", "expected_base_revenue")
    rated = with_rate(groups.join(headers, "inc_hdr_id"), t.fx_rates, F.col("incentive_currency"), F.col("effective_from"), "C0")
    sums = rated.groupBy("inc_hdr_id").agg(F.sum(F.col("expected_base_revenue") * F.col("fx_rate")).alias("total"))
    joined = headers.select("inc_hdr_id").join(sums, "inc_hdr_id", "left")
    return joined.select("inc_hdr_id", F.coalesce("total", F.lit(0)).alias("expected"))


@query(
    "agg_conditional_sum",
    f"""SELECT r.rule_header_id AS inc_hdr_id,
        {num("sum(CASE WHEN c.add_hdr_id IS NOT NULL THEN 0 ELSE r.expected_payout END)", 'expected_sum')},
        {num("sum(CASE WHEN c.add_hdr_id IS NOT NULL THEN 0 ELSE r.forecast_payout END)", 'forecast_sum')}
    FROM inc_rule_comp_hdr r LEFT JOIN inc_add_hdr c ON c.add_hdr_id = r.add_hdr_id AND c.status = 'CANCELLED' GROUP BY 1""",
)
def agg_conditional_sum(t):
    return children.payout_sums(t.inc_rule_comp_hdr, t.inc_add_hdr).select("inc_hdr_id", "expected_sum", "forecast_sum")


TIER1_CTE = """slab AS (SELECT r.rule_header_id AS inc_hdr_id, b.booking_product_code AS product, v.measure_from * 2 / 100 AS target
        FROM inc_rule_comp_value v JOIN inc_rule_comp_period p ON p.rule_comp_period_id = v.rule_comp_period_id
        JOIN inc_rule_comp_hdr r ON r.rule_comp_hdr_id = p.rule_comp_hdr_id JOIN inc_rbd_products b ON b.rbd_product_id = r.rbd_value
        WHERE v.slab_number = '1'),
    tier1 AS (SELECT inc_hdr_id, CASE WHEN count(*) FILTER (WHERE product = 'PLBOVERALL') > 0
            THEN sum(target) FILTER (WHERE product = 'PLBOVERALL')
            ELSE sum(target) FILTER (WHERE product IN ('PLBPREM', 'PLBECO')) END AS tier1_target
        FROM slab WHERE product IN ('PLBOVERALL', 'PLBPREM', 'PLBECO') GROUP BY inc_hdr_id)"""


@query("agg_scaled_sum", f"WITH {TIER1_CTE} SELECT inc_hdr_id, {num('tier1_target')} FROM tier1")
def agg_scaled_sum(t):
    return children.first_slab_targets(
        t.inc_rule_comp_hdr, t.inc_rule_comp_period, t.inc_rule_comp_value, t.inc_rbd_products
    ).select("inc_hdr_id", "tier1_target")


@query(
    "agg_user_roles",
    """SELECT u.user_name, string_agg(r.role_code, ',' ORDER BY r.role_code) AS role_codes FROM um_user_master u
    JOIN um_user_privilege p ON p.user_id = u.user_id JOIN um_role_master r ON r.role_id = p.role_id
    WHERE u.active = 'Y' AND p.active = 'Y' AND r.active = 'Y' GROUP BY u.user_name""",
)
def agg_user_roles(t):
    roles = joins.user_roles(t.um_user_master, t.um_user_privilege, t.um_role_master)
    return aggregates.ordered_lists(roles, ["user_name"], {"role_codes": (F.col("role_code"), [F.col("role_code")], ",")})


RANKED_SQL = f"""SELECT inc_hdr_id, {stamp('created_date')},
    CAST(rank() OVER (ORDER BY created_date DESC NULLS FIRST) AS BIGINT) AS rnk FROM inc_hdr"""


@query("window_rank", RANKED_SQL)
def window_rank(t):
    return ranking.with_rank(t.inc_hdr.select("inc_hdr_id", "created_date"), "created_date")


@query("page_by_rank", f"SELECT * FROM ({RANKED_SQL}) WHERE rnk > 400 AND rnk <= 600")
def page_by_rank(t):
    return ranking.page_by_rank(t.inc_hdr.select("inc_hdr_id", "created_date"), "created_date", number=3, size=200)


@query(
    "page_after_filter",
    f"""SELECT * FROM (SELECT h.inc_hdr_id, g.agreement_group_id, {derived_status_sql('MAGIQ')} AS agreement_new_status,
        CAST(rank() OVER (ORDER BY h.created_date DESC NULLS FIRST) AS BIGINT) AS rnk
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id)
    WHERE agreement_new_status IN ('PENDING', 'EXPIRED') AND rnk > 1000 AND rnk <= 2000""",
)
def page_after_filter(t):
    headers = t.inc_hdr.select("inc_hdr_id", "status", "task_pending_with", "created_date")
    groups = t.inc_agreement_group.select("inc_hdr_id", "agreement_group_id", "effective_from", "effective_to")
    page = ranking.page_by_rank(headers.join(groups, "inc_hdr_id"), "created_date", number=2, size=1000)
    page = page.withColumn("agreement_new_status", derived_status("MAGIQ", dt.date(1999, 6, 30)))
    kept = page.where(F.col("agreement_new_status").isin("PENDING", "EXPIRED"))
    return kept.select("inc_hdr_id", "agreement_group_id", "agreement_new_status", "rnk")


CONTACTS_SQL = """SELECT k.customer_profile_id, p.cpname, q.paname, r.cpemail, s.paemail FROM (
        SELECT DISTINCT customer_profile_id FROM contact_details WHERE contact_type IN ('SMEADMIN', 'PAADMIN', 'PA')) k
    LEFT JOIN (SELECT customer_profile_id, arg_max(coalesce(first_name, '') || ' ' || coalesce(last_name, ''), contact_detail_id) AS cpname
        FROM contact_details WHERE contact_type = 'SMEADMIN' GROUP BY 1) p ON p.customer_profile_id = k.customer_profile_id
    LEFT JOIN (SELECT customer_profile_id, arg_max(coalesce(first_name, '') || ' ' || coalesce(last_name, ''), contact_detail_id) AS paname
        FROM contact_details WHERE contact_type IN ('PAADMIN', 'PA') GROUP BY 1) q ON q.customer_profile_id = k.customer_profile_id
    LEFT JOIN (SELECT d.customer_profile_id, arg_max(m.communication_value, d.contact_detail_id) AS cpemail
        FROM contact_details d JOIN contact_communication m ON m.contact_detail_id = d.contact_detail_id
        WHERE d.contact_type = 'SMEADMIN' AND m.communication_type = 'EMAIL' GROUP BY 1) r ON r.customer_profile_id = k.customer_profile_id
    LEFT JOIN (SELECT d.customer_profile_id, arg_max(m.communication_value, d.contact_detail_id) AS paemail
        FROM contact_details d JOIN contact_communication m ON m.contact_detail_id = d.contact_detail_id
        WHERE d.contact_type IN ('PAADMIN', 'PA') AND m.communication_type = 'EMAIL' GROUP BY 1) s
        ON s.customer_profile_id = k.customer_profile_id"""


@query("topk_per_group", CONTACTS_SQL)
def topk_per_group(t):
    return joins.contact_people(t.contact_details, t.contact_communication)


@query(
    "first_row_any",
    """SELECT inc_hdr_id, arg_min(current_tier, deal_code) AS tier_code, min(membership_number) AS deal_membership
    FROM offer_deal_codes GROUP BY inc_hdr_id""",
)
def first_row_any(t):
    return children.first_deals(t.offer_deal_codes)


@query(
    "sort_desc_first_col",
    "SELECT inc_hdr_id, deal_code, master_agreement FROM inc_associated_accounts ORDER BY 1 DESC",
)
def sort_desc_first_col(t):
    return t.inc_associated_accounts.orderBy(F.desc_nulls_first("inc_hdr_id"))
