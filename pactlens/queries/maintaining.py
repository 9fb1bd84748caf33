"""Maintenance jobs; the result is the rewritten table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens.operators import maintenance
from pactlens.queries.registry import big, query, stamp
from pactlens.session import scratch_path

COPIED = f"created_by, {stamp('created_date')}, last_modified_by, {stamp('last_modified_date')}, subscriber_code"
ERROR_COLUMNS = f"module_code, error_code, error_warning_ind, error_description, {COPIED}"


@query(
    "insert_select_clone",
    f"""SELECT {ERROR_COLUMNS} FROM gen_error_code UNION ALL
    SELECT module_code, 'NEW_CODE', error_warning_ind, 'New description.', {COPIED}
    FROM gen_error_code WHERE error_code = 'E42'""",
)
def insert_select_clone(t):
    return maintenance.append_clones(
        t.gen_error_code, F.col("error_code") == "E42", error_code="NEW_CODE", error_description="New description."
    )


@query(
    "update_in_subquery",
    """SELECT lead_id, customer_profile_id, CASE WHEN customer_profile_id IN (SELECT customer_profile_id FROM customer_profile
        WHERE customer_code IN ('CC17', 'CC4', 'CC93')) THEN 'REJECTED' ELSE status END AS status FROM lead_header""",
)
def update_in_subquery(t):
    keys = t.customer_profile.where(F.col("customer_code").isin("CC17", "CC4", "CC93")).select("customer_profile_id")
    return maintenance.set_where_in(t.lead_header, "customer_profile_id", keys, status="REJECTED")


@query(
    "update_by_file",
    """SELECT lead_id, customer_profile_id, CASE WHEN customer_profile_id IN (SELECT customer_profile_id FROM customer_profile
        WHERE customer_code IN ('CC17', 'CC4')) THEN 'REJECTED' ELSE status END AS status FROM lead_header""",
)
def update_by_file(t):
    """The update on a stored table whose files lie in ranges of the customer: only files with a match are rewritten."""
    stored, target = scratch_path(t.spark, "leads"), scratch_path(t.spark, "leads-rewritten")
    t.lead_header.repartitionByRange(16, "customer_profile_id").write.parquet(stored)
    keys = t.customer_profile.where(F.col("customer_code").isin("CC17", "CC4")).select("customer_profile_id")
    files = maintenance.update_files(t.spark, stored, target, "customer_profile_id", keys, status="REJECTED")
    return maintenance.read_files(t.spark, files, t.spark.read.parquet(stored))


@query(
    "update_by_key",
    f"""SELECT {ERROR_COLUMNS.replace('error_description', "CASE WHEN error_code = 'E75' THEN 'Address is invalid.' ELSE error_description END AS error_description")}
    FROM gen_error_code""",
)
def update_by_key(t):
    return maintenance.set_where(t.gen_error_code, F.col("error_code") == "E75", error_description="Address is invalid.")


@query(
    "update_cascade",
    """SELECT 'lead' AS changed, lead_id AS id, CASE WHEN customer_profile_id IN (SELECT customer_profile_id FROM customer_profile
        WHERE customer_code IN ('CC5', 'CC8')) THEN 'REJECTED' ELSE status END AS status FROM lead_header
    UNION ALL SELECT 'customer', customer_profile_id, CASE WHEN customer_code IN ('CC5', 'CC8') THEN 'INACTIVE' ELSE customer_status END
    FROM customer_profile""",
)
def update_cascade(t):
    leads, customers = maintenance.reject_customers(t.lead_header, t.customer_profile, ["CC5", "CC8"])
    left = leads.select(F.lit("lead").alias("changed"), F.col("lead_id").alias("id"), "status")
    return left.unionByName(
        customers.select(F.lit("customer").alias("changed"), F.col("customer_profile_id").alias("id"), F.col("customer_status").alias("status"))
    )


@query(
    "widen_text_column",
    f"""SELECT 'base' AS source, request_id, {big('length(remarks)', 'width')} FROM amendment_request WHERE length(remarks) > 1000
    UNION ALL SELECT 'audit', request_id, {big('length(remarks)', 'width')} FROM amendment_request_aud WHERE length(remarks) > 1000""",
)
def widen_text_column(t):
    parts = [
        maintenance.text_violations(table, "remarks", 1000).select(
            F.lit(name).alias("source"), "request_id", F.char_length("remarks").alias("width")
        )
        for name, table in (("base", t.amendment_request), ("audit", t.amendment_request_aud))
    ]
    return parts[0].unionByName(parts[1])
