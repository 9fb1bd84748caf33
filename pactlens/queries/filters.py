"""Filters of the agreement search, each over its whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pactlens.operators import filters, joins
from pactlens.plans import measures
from pactlens.queries.fragments import derived_status_sql
from pactlens.queries.registry import AS_OF, query, stamp

HEADER_ID = "inc_hdr_id"


@query(
    "filter_equals",
    f"""SELECT inc_hdr_id, status, {stamp('created_date')} FROM inc_hdr
    WHERE sales_product_code = 'PLB' AND customer_type = 'CORP'""",
)
def filter_equals(t):
    test = filters.equals(F.col("sales_product_code"), "PLB") & filters.equals(F.col("customer_type"), "CORP")
    return t.inc_hdr.where(test).select(HEADER_ID, "status", "created_date")


@query(
    "filter_optional_strict",
    """SELECT 'given' AS variant, inc_hdr_id, source_type FROM inc_hdr WHERE source_type = 'F'
    UNION ALL SELECT 'absent', inc_hdr_id, source_type FROM inc_hdr WHERE source_type = source_type""",
)
def filter_optional_strict(t):
    return _variants(t.inc_hdr, "source_type", {"given": "F", "absent": None}, filters.optional_strict)


def _variants(df, column, values, make):
    """One result per parameter value, told apart by `variant`."""
    parts = []
    for variant, value in values.items():
        test = make(F.col(column), value)
        kept = df if test is None else df.where(test)
        parts.append(kept.select(F.lit(variant).alias("variant"), HEADER_ID, column))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "filter_optional_sentinel",
    """SELECT 'given' AS variant, inc_hdr_id, promo_code FROM inc_hdr WHERE coalesce(promo_code, '##') = 'P3'
    UNION ALL SELECT 'absent', inc_hdr_id, promo_code FROM inc_hdr WHERE coalesce(promo_code, '##') = coalesce(promo_code, '##')""",
)
def filter_optional_sentinel(t):
    return _variants(t.inc_hdr, "promo_code", {"given": "P3", "absent": None}, filters.optional_keep_null)


@query(
    "filter_optional_two_source",
    """SELECT h.inc_hdr_id, a.add_hdr_id, h.cons_status AS header_cons, a.cons_status AS addendum_cons
    FROM inc_hdr h LEFT JOIN inc_add_hdr a ON a.inc_hdr_id = h.inc_hdr_id
    WHERE coalesce(h.cons_status, '#') = 'OPEN' OR coalesce(a.cons_status, '#') = 'OPEN'""",
)
def filter_optional_two_source(t):
    addenda = t.inc_add_hdr.select(HEADER_ID, "add_hdr_id", F.col("cons_status").alias("addendum_cons"))
    joined = t.inc_hdr.select(HEADER_ID, F.col("cons_status").alias("header_cons")).join(addenda, HEADER_ID, "left")
    return joined.where(filters.optional_two_source(F.col("header_cons"), F.col("addendum_cons"), "OPEN"))


@query("filter_in_list", "SELECT inc_hdr_id, status FROM inc_hdr WHERE status IN ('APPROVED', 'INITIAL', 'PENDING')")
def filter_in_list(t):
    return t.inc_hdr.where(filters.in_list(F.col("status"), "APPROVED, INITIAL,PENDING,")).select(HEADER_ID, "status")


@query(
    "filter_like_ci",
    """SELECT 'given' AS variant, inc_hdr_id, inc_name FROM inc_hdr WHERE upper(inc_name) LIKE '%' || upper('low') || '%'
    UNION ALL SELECT 'wildcard', inc_hdr_id, inc_name FROM inc_hdr WHERE upper(inc_name) LIKE '%' || upper('1_u%t') || '%'
    UNION ALL SELECT 'absent', inc_hdr_id, inc_name FROM inc_hdr WHERE upper(inc_name) LIKE '%%'""",
)
def filter_like_ci(t):
    return _variants(t.inc_hdr, "inc_name", {"given": "low", "wildcard": "1_u%t", "absent": None}, filters.name_contains)


@query(
    "filter_like_optional",
    """SELECT customer_profile_id, customer_name FROM customer_profile WHERE lower(customer_name) LIKE '%' || lower('R#0000001') || '%'""",
)
def filter_like_optional(t):
    test = filters.name_contains_if_given(F.col("customer_name"), "R#0000001")
    return t.customer_profile.where(test).select("customer_profile_id", "customer_name")


@query(
    "filter_date_between",
    f"""SELECT inc_hdr_id, {stamp('created_date')} FROM inc_hdr
    WHERE CAST(created_date AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-09-30'""",
)
def filter_date_between(t):
    test = filters.created_between(F.col("created_date"), None, dt.date(2000, 9, 30))
    return t.inc_hdr.where(test).select(HEADER_ID, "created_date")


LOW, HIGH = dt.date(1998, 4, 1), dt.date(1999, 3, 31)


def _period(t, test):
    return t.inc_hdr.where(test(F.col("effective_from"), F.col("effective_to"), LOW, HIGH)).select(
        HEADER_ID, "effective_from", "effective_to"
    )


PERIOD_SQL = f"SELECT inc_hdr_id, {stamp('effective_from')}, {stamp('effective_to')} FROM inc_hdr WHERE "


@query(
    "filter_period_touch",
    PERIOD_SQL
    + """CAST(effective_to AS DATE) BETWEEN DATE '1998-04-01' AND DATE '1999-03-31'
    OR CAST(effective_from AS DATE) BETWEEN DATE '1998-04-01' AND DATE '1999-03-31'""",
)
def filter_period_touch(t):
    return _period(t, filters.period_touches)


@query(
    "filter_period_contained",
    PERIOD_SQL
    + "CAST(effective_from AS DATE) >= DATE '1998-04-01' AND CAST(effective_to AS DATE) <= DATE '1999-03-31'",
)
def filter_period_contained(t):
    return _period(t, filters.period_contained)


@query(
    "filter_fiscal_to_calendar",
    PERIOD_SQL
    + """sales_product_code = 'PLB' AND strftime(DATE '1998-04-01', '%d%m') = '0104' AND strftime(DATE '1999-03-31', '%d%m') = '3103'
    AND CAST(effective_from AS DATE) = DATE '1998-01-01' AND CAST(effective_to AS DATE) = DATE '1998-12-31'""",
)
def filter_fiscal_to_calendar(t):
    return _period(
        t, lambda start, end, low, high: (F.col("sales_product_code") == "PLB") & filters.fiscal_year_as_calendar(start, end, low, high)
    )


@query(
    "filter_substring_either_way",
    """SELECT 'part' AS variant, inc_hdr_id, task_pending_with FROM inc_hdr
        WHERE instr(task_pending_with, 'R2') > 0 OR instr('R2', task_pending_with) > 0 OR task_pending_with IN ('R2')
    UNION ALL SELECT 'whole', inc_hdr_id, task_pending_with FROM inc_hdr
        WHERE instr(task_pending_with, 'R1,R2,R3') > 0 OR instr('R1,R2,R3', task_pending_with) > 0
        OR task_pending_with IN ('R1', 'R2', 'R3')
    UNION ALL SELECT 'all', inc_hdr_id, task_pending_with FROM inc_hdr""",
)
def filter_substring_either_way(t):
    return _variants(t.inc_hdr, "task_pending_with", {"part": "R2", "whole": "R1,R2,R3", "all": "ALL"}, filters.pending_with)


@query(
    "filter_master_switch",
    """SELECT s.soto, g.agreement_group_id, g.master_agreement FROM inc_agreement_group g,
        (VALUES ('N'), ('Y'), ('X')) AS s(soto)
    WHERE coalesce(g.master_agreement, 'Y') = CASE s.soto WHEN 'N' THEN 'Y' WHEN 'Y' THEN 'N' END""",
)
def filter_master_switch(t):
    parts = [
        t.inc_agreement_group.where(filters.master_switch(F.col("master_agreement"), soto)).select(
            F.lit(soto).alias("soto"), "agreement_group_id", "master_agreement"
        )
        for soto in ("N", "Y", "X")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TASK_ROWS = 1_000_000  # headers and groups that one task sorts


def _join_headers(headers, groups):
    """Headers with their groups, sorted in partitions whose number follows the number of rows.

    Compressed files look small enough to broadcast long before their rows are, and sorted keys shrink so well in a shuffle that
    partitions merged up to a size in bytes hold ever more rows.
    """
    parts = (headers.count() + groups.count()) // TASK_ROWS
    if parts >= headers.sparkSession.sparkContext.defaultParallelism:
        headers, groups = (side.repartition(parts, HEADER_ID) for side in (headers, groups))
    return headers.join(groups.hint("merge"), HEADER_ID)


def _header_groups(t):
    headers = t.inc_hdr.select(HEADER_ID, "incentive_city", "incentive_country")
    groups = t.inc_agreement_group.select(HEADER_ID, "agreement_group_id", "country_code", "master_agreement", "add_hdr_id")
    return _join_headers(headers, groups)


HEADER_GROUPS_SQL = """SELECT h.inc_hdr_id, g.agreement_group_id, g.country_code
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id WHERE """


@query("filter_mode_dependent", HEADER_GROUPS_SQL + "g.country_code = h.incentive_country AND g.add_hdr_id IS NULL")
def filter_mode_dependent(t):
    test = filters.all_of(
        filters.home_country_unless_soto(F.col("country_code"), F.col("incentive_country"), "N"),
        filters.no_addendum_unless_soto(F.col("add_hdr_id"), "N"),
    )
    return _header_groups(t).where(test).select(HEADER_ID, "agreement_group_id", "country_code")


@query(
    "filter_location_scope",
    """SELECT 'territory' AS variant, h.inc_hdr_id, g.agreement_group_id
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id
    WHERE h.incentive_city IN (SELECT location_code FROM location_hierarchy WHERE territory_code IN ('T2', 'T5'))
    UNION ALL
    SELECT 'region', h.inc_hdr_id, g.agreement_group_id
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id
    WHERE h.incentive_city IN (SELECT location_code FROM location_hierarchy WHERE region_code = 'R3')
    UNION ALL
    SELECT 'city', h.inc_hdr_id, g.agreement_group_id
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id WHERE h.incentive_city IN ('CT3', 'CT77')
    UNION ALL
    SELECT 'soto', h.inc_hdr_id, g.agreement_group_id
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id
    WHERE g.country_code IN ('N3', 'N7') AND g.master_agreement = 'N'""",
)
def filter_location_scope(t):
    from pactlens.operators.joins import location_scope

    df = _header_groups(t).withColumnRenamed("country_code", "group_country_code")
    variants = {
        "territory": ("TERRITORY", "T2,T5", "N"),
        "region": ("REGION", "R3", "N"),
        "city": ("CITY", "CT3, CT77", "N"),
        "soto": ("COUNTRY", "N3,N7", "Y"),
    }
    parts = [
        location_scope(df, t.location_hierarchy, *args).select(F.lit(name).alias("variant"), HEADER_ID, "agreement_group_id")
        for name, args in variants.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "filter_soto_country",
    HEADER_GROUPS_SQL
    + """h.incentive_country IN ('N3', 'N4', 'N9') AND g.country_code IN ('N3', 'N9', 'N11') AND g.master_agreement = 'N'""",
)
def filter_soto_country(t):
    test = filters.soto_country(
        F.col("country_code"), F.col("incentive_country"), F.col("master_agreement"), "Y", "N", "N3,N4,N9", "N3,N9,N11"
    )
    return _header_groups(t).where(test).select(HEADER_ID, "agreement_group_id", "country_code")


@query("filter_requested_by_me", "SELECT inc_hdr_id, created_by FROM inc_hdr WHERE created_by = 'U7'")
def filter_requested_by_me(t):
    return t.inc_hdr.where(filters.requested_by(F.col("created_by"), "Y", "U7")).select(HEADER_ID, "created_by")


@query(
    "filter_on_derived",
    f"""SELECT * FROM (SELECT h.inc_hdr_id, g.agreement_group_id, {derived_status_sql("MAGIQ")}
        AS agreement_new_status
    FROM inc_hdr h JOIN inc_agreement_group g ON g.inc_hdr_id = h.inc_hdr_id) WHERE agreement_new_status IN ('ACTIVE', 'EXPIRED')""",
)
def filter_on_derived(t):
    headers = t.inc_hdr.select(HEADER_ID, "status", "task_pending_with")
    groups = t.inc_agreement_group.select(HEADER_ID, "agreement_group_id", "effective_from", "effective_to")
    status = measures.derived_status("MAGIQ", dt.date.fromisoformat(AS_OF))
    derived = _join_headers(headers, groups).withColumn("agreement_new_status", status)
    return derived.where(filters.in_list(F.col("agreement_new_status"), "ACTIVE,EXPIRED")).select(
        HEADER_ID, "agreement_group_id", "agreement_new_status"
    )


@query(
    "filter_not_equal_nulls",
    "SELECT add_hdr_id, cons_status, status FROM inc_add_hdr WHERE cons_status <> 'COMPLETED' AND status <> 'CANCELLED'",
)
def filter_not_equal_nulls(t):
    test = filters.not_equal(F.col("cons_status"), "COMPLETED") & filters.not_equal(F.col("status"), "CANCELLED")
    return t.inc_add_hdr.where(test).select("add_hdr_id", "cons_status", "status")
