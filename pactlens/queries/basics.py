"""Scans, projections, conditional expressions and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens.functions import dates
from pactlens.functions.conditional import decode, first_match, label, nvl
from pactlens.functions.numbers import percent, round_half_away
from pactlens.functions.text import full_name, join_text, split_list
from pactlens.operators import aggregates, joins
from pactlens.queries.registry import big, day, num, query, stamp
from pactlens.schemas import TIER_LABELS


@query("scan_table", "SELECT contact_detail_id, agent_profile_id FROM agent_portal_access")
def scan_table(t):
    return t.agent_portal_access


@query(
    "scan_filtered",
    "SELECT add_hdr_id, add_name, add_type, status, cons_status, task_pending_with FROM inc_add_hdr WHERE inc_hdr_id = 357",
)
def scan_filtered(t):
    return t.inc_add_hdr.where(F.col("inc_hdr_id") == 357).drop("inc_hdr_id")


@query("scan_codes_of_type", "SELECT code, description FROM mst_code_dtl WHERE code_type = 'INCPAYFREQ'")
def scan_codes_of_type(t):
    return joins.codes_of_type(t.mst_code_dtl, "INCPAYFREQ").select("code", "description")


@query(
    "derived_table",
    """SELECT a.inc_hdr_id, a.add_hdr_id, a.add_type, c.description
    FROM (SELECT inc_hdr_id, add_hdr_id, add_type FROM inc_add_hdr WHERE cons_status <> 'COMPLETED') a
    JOIN (SELECT code, description FROM mst_code_dtl WHERE code_type = 'ADDENDMTYPE') c ON c.code = a.add_type""",
)
def derived_table(t):
    open_addenda = t.inc_add_hdr.where(F.col("cons_status") != "COMPLETED").select("inc_hdr_id", "add_hdr_id", "add_type")
    types = joins.codes_of_type(t.mst_code_dtl, "ADDENDMTYPE").select("code", "description")
    return open_addenda.join(types, F.col("add_type") == F.col("code")).drop("code")


@query(
    "csv_list_source",
    """SELECT inc_hdr_id, trim(item) AS item FROM (SELECT inc_hdr_id, unnest(string_split(task_pending_with, ',')) AS item
    FROM inc_hdr) WHERE trim(item) <> ''""",
)
def csv_list_source(t):
    return t.inc_hdr.select("inc_hdr_id", F.explode(split_list(F.col("task_pending_with"))).alias("item"))


@query(
    "hierarchy_view_scan",
    """SELECT h.inc_hdr_id, h.incentive_city FROM inc_hdr h
    WHERE h.incentive_city IN (SELECT location_code FROM location_hierarchy WHERE territory_code IN ('T1', 'T4'))""",
)
def hierarchy_view_scan(t):
    cities = joins.location_cities(t.location_hierarchy, "TERRITORY", "T1, T4")
    headers = t.inc_hdr.select("inc_hdr_id", "incentive_city")
    return headers.join(cities, headers["incentive_city"] == cities["city_code"], "left_semi")


@query(
    "project_rename",
    "SELECT inc_hdr_id, incentive_city AS inc_city_code, 'M' || customer_profile_id AS membership_number FROM inc_hdr",
)
def project_rename(t):
    return t.inc_hdr.select(
        "inc_hdr_id",
        F.col("incentive_city").alias("inc_city_code"),
        join_text(F.lit("M"), F.col("customer_profile_id")).alias("membership_number"),
    )


@query(
    "project_star_mix",
    f"""SELECT a.address_type, h.inc_hdr_id, h.status, h.inc_name, {stamp('h.created_date')}, a.address_type AS address_type_2,
        h.status AS status_2
    FROM inc_hdr h JOIN customer_address a ON a.customer_profile_id = h.customer_profile_id""",
)
def project_star_mix(t):
    headers = t.inc_hdr.select("inc_hdr_id", "status", "inc_name", "created_date", "customer_profile_id").alias("ih")
    joined = headers.join(t.customer_address.alias("ca"), "customer_profile_id")
    return joined.select(
        "ca.address_type",
        "ih.*",
        F.col("ca.address_type").alias("address_type_2"),
        F.col("ih.status").alias("status_2"),
    ).drop("customer_profile_id")


@query(
    "project_constants",
    """SELECT inc_hdr_id, CAST(0 AS BIGINT) AS miles_eligible, CAST(0 AS BIGINT) AS total_revenue,
        CAST(NULL AS VARCHAR) AS retro_period FROM inc_hdr""",
)
def project_constants(t):
    return t.inc_hdr.select(
        "inc_hdr_id",
        F.lit(0).cast("bigint").alias("miles_eligible"),
        F.lit(0).cast("bigint").alias("total_revenue"),
        F.lit(None).cast("string").alias("retro_period"),
    )


@query(
    "searched_case",
    """SELECT inc_hdr_id, CASE WHEN task_pending_with IS NULL THEN NULL WHEN task_pending_with <> 'Not Applicable' THEN 'PENDING'
        WHEN status IN ('CANCELLED', 'REJECTED') THEN 'CLOSED' ELSE status END AS state FROM inc_hdr""",
)
def searched_case(t):
    state = first_match(
        [
            (F.col("task_pending_with").isNull(), None),
            (F.col("task_pending_with") != "Not Applicable", "PENDING"),
            (F.col("status").isin("CANCELLED", "REJECTED"), "CLOSED"),
        ],
        F.col("status"),
    )
    return t.inc_hdr.select("inc_hdr_id", state.alias("state"))


@query(
    "simple_case",
    """SELECT inc_hdr_id, deal_code, CASE current_tier WHEN 'EL' THEN 'Elevate' WHEN 'AC' THEN 'Accelerate'
        WHEN 'AS' THEN 'Ascent' ELSE current_tier END AS tier FROM offer_deal_codes""",
)
def simple_case(t):
    return t.offer_deal_codes.select("inc_hdr_id", "deal_code", label(F.col("current_tier"), TIER_LABELS).alias("tier"))


@query(
    "decode_map",
    """SELECT add_hdr_id, CASE WHEN task_pending_with = 'NA' THEN 'Not Applicable' ELSE task_pending_with END AS pending,
        CASE WHEN cons_status IS NULL THEN 'NONE' WHEN cons_status = 'OPEN' THEN 'O' END AS cons FROM inc_add_hdr""",
)
def decode_map(t):
    pending = F.col("task_pending_with")
    return t.inc_add_hdr.select(
        "add_hdr_id",
        decode(pending, {"NA": "Not Applicable"}, pending).alias("pending"),
        decode(F.col("cons_status"), {None: "NONE", "OPEN": "O"}).alias("cons"),
    )


@query(
    "nvl_default",
    f"""SELECT agreement_group_id, coalesce(master_agreement, 'Y') AS soto_master,
        {num('coalesce(coalesce(forecast_base_rev, expected_base_revenue), 0)', 'revenue')} FROM inc_agreement_group""",
)
def nvl_default(t):
    return t.inc_agreement_group.select(
        "agreement_group_id",
        nvl(F.col("master_agreement"), "Y").alias("soto_master"),
        nvl(nvl(F.col("forecast_base_rev"), F.col("expected_base_revenue")), 0).alias("revenue"),
    )


@query(
    "count_case_flag",
    """SELECT h.inc_hdr_id, CASE WHEN (SELECT count(*) FROM inc_process_dtl p WHERE p.inc_hdr_id = h.inc_hdr_id) > 0
        THEN 'Y' ELSE 'N' END AS has_approval FROM inc_hdr h""",
)
def count_case_flag(t):
    return aggregates.with_flag(t.inc_hdr.select("inc_hdr_id"), t.inc_process_dtl, "inc_hdr_id", "has_approval")


@query(
    "fn_case_fold",
    "SELECT inc_hdr_id, upper(task_pending_with) AS upper_pending, lower(inc_name) AS lower_name FROM inc_hdr",
)
def fn_case_fold(t):
    return t.inc_hdr.select(
        "inc_hdr_id", F.upper("task_pending_with").alias("upper_pending"), F.lower("inc_name").alias("lower_name")
    )


@query(
    "fn_concat",
    """SELECT contact_detail_id, coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS contact_name FROM contact_details""",
)
def fn_concat(t):
    return t.contact_details.select("contact_detail_id", full_name(F.col("first_name"), F.col("last_name")).alias("contact_name"))


@query(
    "fn_instr",
    """SELECT inc_hdr_id, CAST(instr(task_pending_with, 'R2') AS BIGINT) AS position,
        CAST(instr('R1,R2,R3', task_pending_with) AS BIGINT) AS reverse_position FROM inc_hdr""",
)
def fn_instr(t):
    return t.inc_hdr.select(
        "inc_hdr_id",
        F.instr("task_pending_with", "R2").alias("position"),
        F.expr("instr('R1,R2,R3', task_pending_with)").alias("reverse_position"),
    )


@query("fn_like", "SELECT inc_hdr_id, inc_name FROM inc_hdr WHERE inc_name LIKE '%-%I%'")
def fn_like(t):
    return t.inc_hdr.where(F.col("inc_name").like("%-%I%")).select("inc_hdr_id", "inc_name")


@query(
    "fn_trunc_date",
    f"SELECT inc_hdr_id, {day('CAST(created_date AS DATE)', 'created_day')} FROM inc_hdr WHERE CAST(created_date AS DATE) <= DATE '1999-06-30'",
)
def fn_trunc_date(t):
    kept = t.inc_hdr.where(dates.on_or_before(F.col("created_date"), dates.as_date("1999-06-30")))
    return kept.select("inc_hdr_id", dates.truncate_day(F.col("created_date")).alias("created_day"))


@query(
    "fn_to_char_date",
    "SELECT inc_hdr_id, strftime(effective_from, '%d%m') AS day_month, strftime(effective_from, '%Y') AS year FROM inc_hdr",
)
def fn_to_char_date(t):
    start = F.col("effective_from")
    return t.inc_hdr.select("inc_hdr_id", dates.day_and_month(start).alias("day_month"), dates.year_text(start).alias("year"))


@query(
    "fn_to_date",
    f"""SELECT inc_hdr_id, {day("CAST(strptime('01-01-' || strftime(effective_from, '%Y'), '%d-%m-%Y') AS DATE)", 'year_start')}
    FROM inc_hdr""",
)
def fn_to_date(t):
    text = join_text(F.lit("01-01-"), dates.year_text(F.col("effective_from")))
    return t.inc_hdr.select("inc_hdr_id", dates.date_from_text(text).alias("year_start"))


@query(
    "fn_round",
    f"""SELECT agreement_group_id, {num('round(forecast_base_rev, 3)', 'rounded3')}, {num('round(-forecast_base_rev, 2)', 'rounded2')}
    FROM inc_agreement_group""",
)
def fn_round(t):
    forecast = F.col("forecast_base_rev")
    return t.inc_agreement_group.select(
        "agreement_group_id",
        round_half_away(forecast, 3).alias("rounded3"),
        round_half_away(-forecast, 2).alias("rounded2"),
    )


@query(
    "fn_arith",
    f"""SELECT agreement_group_id, {num('forecast_base_rev - expected_base_revenue', 'gap')},
        CASE WHEN expected_base_revenue <> 0 THEN round(CAST(forecast_base_rev - expected_base_revenue AS DOUBLE)
            / CAST(expected_base_revenue AS DOUBLE) * 100, 3) END AS gap_percent FROM inc_agreement_group""",
)
def fn_arith(t):
    gap = F.col("forecast_base_rev") - F.col("expected_base_revenue")
    return t.inc_agreement_group.select(
        "agreement_group_id", gap.alias("gap"), percent(gap, F.col("expected_base_revenue")).alias("gap_percent")
    )


@query(
    "fn_split_list",
    f"""SELECT inc_hdr_id, {big("len(string_split(task_pending_with, ','))", 'items')},
        trim(string_split(task_pending_with, ',')[-1]) AS last_item FROM inc_hdr""",
)
def fn_split_list(t):
    items = split_list(F.col("task_pending_with"))
    return t.inc_hdr.select(
        "inc_hdr_id",
        F.when(F.col("task_pending_with").isNotNull(), F.size(items)).alias("items"),
        F.element_at(items, -1).alias("last_item"),
    )
