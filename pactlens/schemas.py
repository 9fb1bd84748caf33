"""Tables, columns and code values of the agreement model."""

from __future__ import annotations

# Input tables.
TABLES = (
    "account_subscriptions",
    "agent_custom_grp",
    "agent_portal_access",
    "amendment_request",
    "amendment_request_aud",
    "contact_communication",
    "contact_details",
    "customer_address",
    "customer_profile",
    "fx_rates",
    "gen_error_code",
    "inc_add_hdr",
    "inc_agreement_group",
    "inc_associated_accounts",
    "inc_exceptions",
    "inc_hdr",
    "inc_models",
    "inc_payout_types",
    "inc_process_dtl",
    "inc_rbd_products",
    "inc_rule_comp_hdr",
    "inc_rule_comp_period",
    "inc_rule_comp_value",
    "inc_rule_comp_whatif",
    "inc_ticketing_agents",
    "inc_types",
    "lead_header",
    "location_hierarchy",
    "miles_info",
    "mst_city",
    "mst_code_dtl",
    "mst_country",
    "offer_deal_codes",
    "svc_trx_task_plan",
    "um_role_master",
    "um_user_master",
    "um_user_privilege",
    "wf_approval_history",
)

# Product codes that switch rules and measures.
PRODUCT_LOYALTY_BONUS = "PLB"
PRODUCT_BASELINE = "MAGIQ"

# Statuses, labels and code types the queries test for.
CLOSED_STATUSES = ("CANCELLED", "REJECTED")
NOT_APPLICABLE = "Not Applicable"
TIER_LABELS = {"EL": "Elevate", "AC": "Accelerate", "AS": "Ascent"}
OVERALL_PRODUCT = "PLBOVERALL"
SPLIT_PRODUCTS = ("PLBPREM", "PLBECO")
DEFAULT_CHANNEL = "FIT/Retail"
EXCEPTION_CODE_TYPES = ("INC_GLD_RL", "INC_EXP")
FREQUENCY_CODE_TYPE = "INCPAYFREQ"
CHANNEL_CODE_TYPE = "CHNL_TYPE"

# Header columns the search passes through.
HEADER_COLUMNS = (
    "inc_hdr_id",
    "source_type",
    "source_reference",
    "status",
    "sales_product_code",
    "customer_type",
    "customer_profile_id",
    "customer_category",
    "agreement_type",
    "soto_agreement",
    "effective_from",
    "effective_to",
    "master_contract_number",
    "created_by",
    "created_date",
    "last_modified_by",
    "last_modified_date",
    "promo_code",
    "incentive_city",
    "incentive_country",
    "promo_code_url",
    "farebasis_code",
    "ibe_office_id",
    "tkt_instructions",
    "fare_disp_entry",
    "quote_disp_entry",
    "tkt_acc_code",
    "inc_location_basis",
    "config_location_type",
    "loc_modfn_allowed",
    "master_deal_code",
    "activity_id",
    "task_classifier_code",
    "inc_name",
    "task_pending_with",
    "cons_status",
    "parent_inc_id",
    "incremental_revenue",
    "is_reset",
)

# Output columns of the search, in order.
SEARCH_COLUMNS = (
    "inc_hdr_id",
    "source_type",
    "source_reference",
    "status",
    "agreement_new_status",
    "sales_product_code",
    "customer_type",
    "customer_profile_id",
    "customer_category",
    "agreement_type",
    "soto_agreement",
    "inc_from",
    "inc_to",
    "effective_from",
    "effective_to",
    "master_contract_number",
    "created_by",
    "created_date",
    "last_modified_by",
    "last_modified_date",
    "promo_code",
    "incentive_city",
    "incentive_city_code",
    "incentive_country",
    "incentive_country_desc",
    "promo_code_url",
    "farebasis_code",
    "ibe_office_id",
    "tkt_instructions",
    "fare_disp_entry",
    "quote_disp_entry",
    "tkt_acc_code",
    "inc_location_basis",
    "config_location_type",
    "loc_modfn_allowed",
    "master_deal_code",
    "activity_id",
    "task_classifier_code",
    "inc_name",
    "task_pending_with",
    "task_pending_with_desc",
    "master_track_code",
    "rnk",
    "tkt_agent_exists",
    "customer_name",
    "customer_code",
    "cons_status",
    "inc_city_code",
    "agreement_group_id",
    "group_country_code",
    "group_country_code_desc",
    "group_status",
    "soto_master",
    "approver_user",
    "negative_growth",
    "parent_inc_id",
    "miles_earned",
    "miles_redeemed",
    "miles_balance",
    "miles_expiry",
    "miles_expiry_date",
    "membership_number",
    "miles_eligible",
    "miles_non_eligible",
    "total_revenue",
    "industry_description",
    "current_tier",
    "cpname",
    "cpemail",
    "paname",
    "paemail",
    "terminatereason",
    "retro_miles",
    "retro_period",
    "payout_frequency",
    "is_fixed_fund",
    "is_super_plb",
    "is_all_prodcut_cap",
    "initial_expected_rev",
    "forecast_expected_rev",
    "expected_payout",
    "forecast_payout",
    "max_payout",
    "fixed_payout",
    "var_revenue",
    "var_payout",
    "initial_cos",
    "revised_cos",
    "qr_benefit",
    "var_qr_benefit_perc",
    "tier1_target",
    "baseline_target",
    "actual_revenue",
    "variance_rev",
    "var_perc",
    "channel_type",
    "wf_classifier_code",
    "add_hdr_id",
    "has_approval",
    "inc_add_cnt",
    "currency",
    "addendum",
    "addendum_type",
    "addendum_status",
    "addendum_id",
    "exception_code",
    "exception_type",
    "exception_desc",
    "exception_desc_type",
    "workflow_id",
    "is_reset",
)
