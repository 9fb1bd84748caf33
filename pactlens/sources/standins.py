"""Agreement tables derived from the TPC-H-like test tables.

Each table is one SELECT over one test table, written once for both engines: `Dialect` holds the few
functions whose spelling differs. Row-wise formulas only, so a stand-in adds no shuffle to a query.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import SparkSession

from pactlens.sources.tables import AgreementTables


@dataclass(frozen=True)
class Dialect:
    name: str

    def _pick(self, spark: str, duckdb: str) -> str:
        return spark if self.name == "spark" else duckdb

    def div(self, left: str, right: int) -> str:
        return self._pick(f"({left} div {right})", f"({left} // {right})")

    def add_days(self, stamp: str, days: str) -> str:
        return self._pick(
            f"({stamp} + make_dt_interval(CAST({days} AS INT)))", f"({stamp} + to_days(CAST({days} AS INTEGER)))"
        )

    def add_hours(self, stamp: str, hours: str) -> str:
        return self._pick(
            f"({stamp} + make_dt_interval(0, CAST({hours} AS INT)))", f"({stamp} + to_hours(CAST({hours} AS INTEGER)))"
        )

    def day_number(self, stamp: str) -> str:
        return self._pick(
            f"datediff(CAST({stamp} AS DATE), DATE '1990-01-01')",
            f"date_diff('day', DATE '1990-01-01', CAST({stamp} AS DATE))",
        )

    def year_day(self, stamp: str, month: int, day: int) -> str:
        kind = self._pick("TIMESTAMP_NTZ", "TIMESTAMP")
        return f"CAST(make_date(year({stamp}), {month}, {day}) AS {kind})"

    def stamp(self, day: str) -> str:
        kind = self._pick("TIMESTAMP_NTZ", "TIMESTAMP")
        return f"CAST('{day} 00:00:00' AS {kind})"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")


def _row_id(d: Dialect) -> str:
    days = d.day_number("l_shipdate")
    return f"((l_orderkey * 16 + l_linenumber) * 4194304 + ((l_partkey * 31 + l_suppkey) * 4099 + {days}) % 4194304)"


def standin_sql(d: Dialect) -> dict[str, tuple[str, str]]:
    """Table name -> (test table it is derived from, SELECT statement)."""
    k = "o_orderkey"
    row_id = _row_id(d)
    price = "CAST(l_extendedprice AS DECIMAL(12,2))"
    value = "CAST(value AS DECIMAL(12,2))"
    period_from = f"CASE WHEN {k} % 13 = 0 THEN {d.year_day('o_orderdate', 1, 1)} ELSE o_orderdate END"
    period_to = (
        f"CASE WHEN {k} % 13 = 0 THEN {d.year_day('o_orderdate', 12, 31)} "
        f"ELSE {d.add_days('o_orderdate', f'{k} % 700')} END"
    )
    return {
        "inc_hdr": (
            "orders",
            f"""SELECT {k} AS inc_hdr_id,
                CASE WHEN {k} % 11 = 0 THEN NULL ELSE o_orderstatus END AS source_type,
                'SR' || ({k} % 50) AS source_reference,
                CASE {k} % 9 WHEN 0 THEN 'INITIAL' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'ACCEPTED' WHEN 3 THEN 'SUSPENDED'
                    WHEN 4 THEN 'APPROVED' WHEN 5 THEN 'TERMINATED' WHEN 6 THEN 'CANCELLED' WHEN 7 THEN 'REJECTED'
                    ELSE 'EXPIRED' END AS status,
                CASE {d.div(k, 9)} % 3 WHEN 0 THEN 'PLB' WHEN 1 THEN 'MAGIQ' ELSE 'OTHER' END AS sales_product_code,
                CASE WHEN {k} % 4 = 0 THEN 'AGENT' ELSE 'CORP' END AS customer_type,
                o_custkey AS customer_profile_id,
                'CAT' || ({k} % 3) AS customer_category,
                'AT' || ({k} % 2) AS agreement_type,
                CASE {k} % 6 WHEN 0 THEN 'Y' WHEN 1 THEN NULL ELSE 'N' END AS soto_agreement,
                {period_from} AS effective_from,
                {period_to} AS effective_to,
                CASE WHEN {k} % 3 = 0 THEN NULL ELSE 'MC' || ({k} % 21) END AS master_contract_number,
                'U' || ({k} % 20) AS created_by,
                CASE WHEN {k} % 97 = 0 THEN NULL ELSE {d.add_hours('o_orderdate', f'{k} % 24')} END AS created_date,
                'U' || ({k} % 7) AS last_modified_by,
                {d.add_days('o_orderdate', f'{k} % 5')} AS last_modified_date,
                CASE WHEN {k} % 7 = 0 THEN NULL ELSE 'P' || ({k} % 7) END AS promo_code,
                'CT' || ({k} % 120) AS incentive_city,
                'N' || ({k} % 25) AS incentive_country,
                'url' || ({k} % 10) AS promo_code_url,
                'FB' || ({k} % 5) AS farebasis_code,
                'OF' || ({k} % 8) AS ibe_office_id,
                CASE WHEN {k} % 2 = 0 THEN 'TI' || ({k} % 6) END AS tkt_instructions,
                'FD' || ({k} % 3) AS fare_disp_entry,
                'QD' || ({k} % 3) AS quote_disp_entry,
                'TA' || ({k} % 9) AS tkt_acc_code,
                'POS' AS inc_location_basis,
                CASE WHEN {k} % 2 = 0 THEN 'CITY' ELSE 'COUNTRY' END AS config_location_type,
                CASE WHEN {k} % 5 = 0 THEN 'N' ELSE 'Y' END AS loc_modfn_allowed,
                'D' || ({k} % 50) AS master_deal_code,
                {k} AS activity_id,
                'TC' || ({k} % 4) AS task_classifier_code,
                o_orderpriority AS inc_name,
                CASE {d.div(k, 27)} % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Not Applicable' WHEN 2 THEN 'R1,R2'
                    WHEN 3 THEN 'FAREWTHDRW' WHEN 4 THEN 'CMS Integration' ELSE 'R3' END AS task_pending_with,
                CASE {k} % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'OPEN' END AS cons_status,
                CASE WHEN {k} % 5 = 0 THEN {d.div(k, 2)} END AS parent_inc_id,
                CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,4)) AS incremental_revenue,
                CASE WHEN {k} % 8 = 0 THEN 'Y' ELSE 'N' END AS is_reset
            FROM orders""",
        ),
        "inc_agreement_group": (
            "lineitem",
            f"""SELECT {row_id} AS agreement_group_id,
                l_orderkey AS inc_hdr_id,
                CASE l_suppkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PENDING' ELSE 'CLOSED' END AS status,
                CASE WHEN l_linenumber <= 5 THEN 'N' || (l_orderkey % 25)
                    WHEN l_linenumber = 6 THEN 'N' || (l_partkey % 25) END AS country_code,
                'C' || (l_linenumber % 4) AS incentive_currency,
                CASE l_linenumber % 3 WHEN 1 THEN 'Y' WHEN 2 THEN NULL ELSE 'N' END AS master_agreement,
                l_shipdate AS effective_from,
                CASE WHEN l_partkey % 23 <> 0 THEN {d.add_days('l_shipdate', 'l_partkey % 400')} END AS effective_to,
                CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST({price} AS DECIMAL(18,4)) END AS expected_base_revenue,
                CASE WHEN l_returnflag = 'N' THEN NULL
                    ELSE CAST({price} * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) END AS forecast_base_rev,
                CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN {row_id} END AS add_hdr_id,
                {row_id} AS workflow_id,
                'W' || (l_suppkey % 4) AS wf_classifier_code,
                'U' || (l_suppkey % 20) AS approver_user
            FROM lineitem""",
        ),
        "inc_add_hdr": (
            "lineitem",
            f"""SELECT {row_id} AS add_hdr_id,
                l_orderkey AS inc_hdr_id,
                'A' || l_partkey AS add_name,
                CASE WHEN l_linenumber % 2 = 1 THEN 'RULES' ELSE 'TERMS' END AS add_type,
                CASE WHEN l_linestatus = 'O' THEN 'CANCELLED' ELSE 'APPROVED' END AS status,
                CASE l_suppkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'OPEN' END AS cons_status,
                CASE l_suppkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN NULL WHEN 2 THEN 'R1,R2' ELSE 'R3' END AS task_pending_with
            FROM lineitem WHERE l_returnflag = 'R'""",
        ),
        "inc_exceptions": (
            "lineitem",
            f"""SELECT {row_id} AS inc_exception_id,
                l_orderkey AS inc_hdr_id,
                'X' || (l_partkey % 5) AS exception_code,
                'T' || (l_suppkey % 3) AS exception_type,
                CASE WHEN l_returnflag = 'R' THEN {row_id} END AS add_hdr_id
            FROM lineitem WHERE l_quantity > 35""",
        ),
        "inc_associated_accounts": (
            "lineitem",
            """SELECT l_orderkey AS inc_hdr_id,
                'D' || (l_partkey % 50) AS deal_code,
                CASE WHEN l_linenumber = 1 THEN 'Y' ELSE 'N' END AS master_agreement
            FROM lineitem WHERE l_linenumber <= 2""",
        ),
        "inc_models": (
            "lineitem",
            f"""SELECT {row_id} AS inc_model_id, {row_id} AS agreement_group_id
            FROM lineitem WHERE l_partkey % 2 = 0""",
        ),
        "inc_types": (
            "lineitem",
            f"""SELECT {row_id} AS inc_type_id, {row_id} AS inc_model_id,
                CASE WHEN l_linestatus = 'F' THEN 'BASIC' ELSE 'FIXED' END AS incentive_type
            FROM lineitem""",
        ),
        "inc_payout_types": (
            "lineitem",
            f"""SELECT {row_id} AS payout_type_id, {row_id} AS inc_type_id,
                CASE l_suppkey % 4 WHEN 0 THEN 'MTH' WHEN 1 THEN 'QTR' WHEN 2 THEN 'YR' ELSE 'ADH' END AS payment_frequency_type
            FROM lineitem""",
        ),
        "inc_rule_comp_hdr": (
            "lineitem",
            f"""SELECT {row_id} AS rule_comp_hdr_id,
                l_orderkey AS rule_header_id,
                l_partkey AS rbd_value,
                {row_id} AS payout_type_id,
                CASE WHEN l_returnflag = 'R' THEN {row_id} END AS add_hdr_id,
                CAST({price} * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS expected_payout,
                CAST({price} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS forecast_payout,
                CAST({price} * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,4)) AS max_payout,
                CASE WHEN l_linestatus = 'F' THEN 'VALUE' ELSE 'PERC' END AS value_type
            FROM lineitem""",
        ),
        "inc_rule_comp_period": (
            "lineitem",
            f"SELECT {row_id} AS rule_comp_period_id, {row_id} AS rule_comp_hdr_id FROM lineitem",
        ),
        "inc_rule_comp_value": (
            "lineitem",
            f"""SELECT {row_id} AS rule_comp_period_id,
                CAST(l_linenumber % 3 AS STRING) AS slab_number,
                CAST(CAST(l_quantity AS DECIMAL(12,2)) * 1000 AS DECIMAL(18,4)) AS measure_from,
                CASE WHEN l_suppkey % 2 = 0 THEN CAST(CAST(l_quantity AS DECIMAL(12,2)) * 2000 AS DECIMAL(18,4)) END AS measure_to
            FROM lineitem""",
        ),
        "inc_rule_comp_whatif": (
            "lineitem",
            f"""SELECT {row_id} AS rule_comp_hdr_id,
                l_shipdate AS period_from,
                {d.add_days('l_shipdate', '30')} AS period_to,
                CAST(l_quantity AS DECIMAL(12,2)) - 25 AS growth_perc
            FROM lineitem""",
        ),
        "inc_rbd_products": (
            "part",
            """SELECT p_partkey AS rbd_product_id,
                CASE p_partkey % 4 WHEN 0 THEN 'PLBOVERALL' WHEN 1 THEN 'PLBPREM' WHEN 2 THEN 'PLBECO'
                    ELSE p_type END AS booking_product_code
            FROM part""",
        ),
        "inc_ticketing_agents": (
            "lineitem",
            "SELECT l_orderkey AS inc_hdr_id, l_suppkey AS agent_profile_id FROM lineitem WHERE l_linenumber = 3",
        ),
        "inc_process_dtl": (
            "lineitem",
            f"SELECT {row_id} AS process_id, l_orderkey AS inc_hdr_id FROM lineitem WHERE l_linenumber = 4",
        ),
        "wf_approval_history": (
            "lineitem",
            f"""SELECT {row_id} AS wf_request_id,
                'U' || (l_partkey % 20) AS actioned_by,
                CASE WHEN l_returnflag = 'N' THEN 'REJECT' ELSE 'APPROVE' END AS action_code,
                CASE WHEN l_linestatus = 'F' THEN 'APPROVED' ELSE 'OPEN' END AS status
            FROM lineitem""",
        ),
        "svc_trx_task_plan": (
            "orders",
            f"SELECT {k} AS trx_dtl_id, 'TR' || ({k} % 4) AS remarks FROM orders WHERE {k} % 10 <> 0",
        ),
        "offer_deal_codes": (
            "orders",
            f"""SELECT {k} AS inc_hdr_id,
                'D' || o_custkey AS deal_code,
                'M' || o_custkey AS membership_number,
                o_custkey AS account_subscription_id,
                CASE {k} % 8 WHEN 0 THEN 'EL' WHEN 2 THEN 'AC' WHEN 4 THEN 'AS' ELSE 'ZZ' END AS current_tier
            FROM orders WHERE {k} % 2 = 0""",
        ),
        "lead_header": (
            "orders",
            f"SELECT {k} AS lead_id, o_custkey AS customer_profile_id, o_orderstatus AS status FROM orders",
        ),
        "um_user_privilege": (
            "orders",
            f"""SELECT o_custkey AS user_id, {k} % 6 AS role_id,
                CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE 'Y' END AS active
            FROM orders""",
        ),
        "miles_info": (
            "events",
            f"""SELECT 'D' || user_id AS track_code,
                'M' || user_id AS membership_no,
                CAST({value} AS DECIMAL(18,4)) AS miles_earned,
                CAST(CASE WHEN event_type = 'purchase' THEN {value} END AS DECIMAL(18,4)) AS miles_redeemed,
                CAST(CASE WHEN event_type <> 'purchase' THEN {value} ELSE 0 END AS DECIMAL(18,4)) AS miles_balance,
                CAST(CASE WHEN event_type = 'error' THEN {value} ELSE 0 END AS DECIMAL(18,4)) AS miles_expiry,
                CAST(ts AS DATE) AS miles_expiry_date
            FROM events""",
        ),
        "contact_details": (
            "events",
            """SELECT event_id AS contact_detail_id,
                user_id AS customer_profile_id,
                CASE event_type WHEN 'purchase' THEN 'SMEADMIN' WHEN 'signup' THEN 'PAADMIN' WHEN 'view' THEN 'PA'
                    ELSE 'STAFF' END AS contact_type,
                CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'F' || event_id END AS first_name,
                CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'L' || (event_id % 97) END AS last_name
            FROM events""",
        ),
        "contact_communication": (
            "events",
            """SELECT event_id AS contact_detail_id,
                CASE WHEN event_id % 3 = 0 THEN 'PHONE' ELSE 'EMAIL' END AS communication_type,
                'v' || event_id AS communication_value
            FROM events""",
        ),
        "agent_portal_access": (
            "events",
            "SELECT event_id AS contact_detail_id, user_id AS agent_profile_id FROM events WHERE event_type = 'view'",
        ),
        "customer_profile": (
            "customer",
            """SELECT c_custkey AS customer_profile_id,
                c_name AS customer_name,
                'CC' || c_custkey AS customer_code,
                'ACTIVE' AS customer_status,
                c_mktsegment AS industry_sector
            FROM customer""",
        ),
        "customer_address": (
            "customer",
            """SELECT c_custkey AS customer_profile_id, 'LOCATION' AS address_type, 'Street ' || c_custkey AS address_line1,
                CASE WHEN c_custkey % 6 = 0 THEN 'Town ' || (c_custkey % 9)
                    ELSE 'CT' || (c_custkey % 120) END AS city,
                'N' || c_nationkey AS country_code,
                CASE WHEN c_custkey % 10 = 0 THEN 'N' ELSE 'Y' END AS valid
            FROM customer
            UNION ALL
            SELECT c_custkey, 'BILLING', 'Box ' || c_custkey, 'CT' || (c_custkey % 50), 'N' || c_nationkey, 'Y'
            FROM customer WHERE c_custkey % 3 = 0
            UNION ALL
            SELECT c_custkey, 'LOCATION', 'Yard ' || c_custkey, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 'CT' || (c_custkey % 77) END,
                CASE WHEN c_custkey % 2 = 0 THEN 'N' || ((c_nationkey + 3) % 25) ELSE 'XX' END, 'Y'
            FROM customer WHERE c_custkey % 5 = 0""",
        ),
        "account_subscriptions": (
            "customer",
            "SELECT c_custkey AS account_subscription_id FROM customer WHERE c_custkey % 9 <> 0",
        ),
        "agent_custom_grp": (
            "customer",
            """SELECT c_custkey AS customer_profile_id, 'CHNL_TYPE' AS group_type, 'CH' || (c_custkey % 4) AS group_code
            FROM customer WHERE c_custkey % 5 <> 0""",
        ),
        "um_user_master": (
            "customer",
            """SELECT c_custkey AS user_id, 'U' || c_custkey AS user_name,
                CASE WHEN c_custkey % 5 = 0 THEN 'N' ELSE 'Y' END AS active
            FROM customer""",
        ),
        "mst_country": (
            "nation",
            "SELECT 'N' || n_nationkey AS country_code, n_name AS country_name FROM nation",
        ),
        "mst_city": (
            "supplier",
            """SELECT 'CT' || s_suppkey AS city_code, s_name AS city_name, 'N' || s_nationkey AS country_code
            FROM supplier""",
        ),
        "location_hierarchy": (
            "supplier",
            """SELECT 'CT' || s_suppkey AS location_code, 'N' || s_nationkey AS country_code,
                'T' || (s_nationkey % 7) AS territory_code, 'R' || (s_nationkey % 5) AS region_code
            FROM supplier""",
        ),
        "gen_error_code": (
            "part",
            f"""SELECT p_brand AS module_code, 'E' || p_partkey AS error_code,
                CASE WHEN p_size > 25 THEN 'W' ELSE 'E' END AS error_warning_ind,
                p_name AS error_description, 'U' || (p_partkey % 20) AS created_by,
                {d.add_days("TIMESTAMP '1995-01-01 08:30:00'", 'p_partkey % 900')} AS created_date,
                CASE WHEN p_partkey % 3 > 0 THEN 'U' || (p_partkey % 7) END AS last_modified_by,
                CASE WHEN p_partkey % 3 > 0 THEN {d.add_days("TIMESTAMP '1998-01-01 00:00:00'", 'p_partkey % 400')} END AS last_modified_date,
                p_type AS subscriber_code
            FROM part""",
        ),
        "amendment_request": ("documents", "SELECT doc_id AS request_id, text AS remarks FROM documents"),
        "amendment_request_aud": ("pages", "SELECT page_id AS request_id, html AS remarks FROM pages"),
        "fx_rates": (
            "",
            f"""SELECT currency, target_currency, valid_from, CAST(rate AS DECIMAL(9,3)) AS rate FROM (VALUES
                ('C1', 'C0', {d.stamp('1995-01-01')}, 1.250), ('C1', 'C0', {d.stamp('1998-01-01')}, 1.125),
                ('C1', 'C0', {d.stamp('2000-01-01')}, 1.500), ('C2', 'C0', {d.stamp('1995-01-01')}, 0.640),
                ('C2', 'C0', {d.stamp('1998-01-01')}, 0.725), ('C2', 'C0', {d.stamp('2000-01-01')}, 0.810),
                ('C3', 'C0', {d.stamp('1998-01-01')}, 3.640), ('C3', 'C0', {d.stamp('2000-01-01')}, 3.655),
                ('C1', 'C9', {d.stamp('1995-01-01')}, 9.999)) AS t(currency, target_currency, valid_from, rate)""",
        ),
        "um_role_master": (
            "",
            """SELECT role_id, role_code, role_name, active FROM (VALUES
                (0, 'R0', 'Requester', 'Y'), (1, 'R1', 'Sales manager', 'Y'), (2, 'R2', 'Finance', 'Y'),
                (3, 'R3', 'Pricing', 'Y'), (4, 'R4', 'Audit', 'N'), (5, 'R5', 'Support', 'Y'))
                AS t(role_id, role_code, role_name, active)""",
        ),
        "mst_code_dtl": (
            "",
            """SELECT code_type, code, description FROM (VALUES
                ('ADDENDMTYPE', 'RULES', 'Rule change'), ('ADDENDMTYPE', 'TERMS', 'Term change'),
                ('INC_EXP', 'X0', 'Late filing'), ('INC_EXP', 'X1', 'Manual fare'), ('INC_EXP', 'X2', 'Split group'),
                ('INC_GLD_RL', 'X1', 'Golden rule one'), ('INC_GLD_RL', 'X3', 'Golden rule three'),
                ('OTHER', 'X4', 'Unrelated'), ('INCPAYFREQ', 'MTH', 'Monthly'), ('INCPAYFREQ', 'QTR', 'Quarterly'),
                ('INCPAYFREQ', 'YR', 'Yearly'), ('CHNL_TYPE', 'CH0', 'Corporate'), ('CHNL_TYPE', 'CH1', 'Leisure'),
                ('CHNL_TYPE', 'CH2', 'Online'), ('INDUSTRY', 'HOUSEHOLD', 'Household goods'),
                ('INDUSTRY', 'MACHINERY', 'Machinery and tools'), ('SECTOR', 'MACHINERY', 'Heavy industry'),
                ('INDUSTRY', 'BUILDING', 'Construction'), ('TERMREASON', 'TR0', 'Customer request'),
                ('TERMREASON', 'TR1', 'Breach'), ('TERMREASON', 'TR2', 'Merger'))
                AS t(code_type, code, description)""",
        ),
    }


def standin_tables(spark: SparkSession, folder: str) -> AgreementTables:
    """The agreement tables derived from the test tables in `folder`."""
    statements = standin_sql(SPARK)

    @functools.cache
    def read(base: str):
        return spark.read.parquet(f"{folder}/{base}.parquet")

    def load(name: str):
        base, statement = statements[name]
        if not base:
            return spark.sql(statement)
        return spark.sql(statement.replace(f"FROM {base}", "FROM {base}"), base=read(base))

    return AgreementTables(spark, load)
