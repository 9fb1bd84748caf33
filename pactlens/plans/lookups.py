"""Ad-hoc lookups over several tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.sources.tables import AgreementTables


def deal_overview(tables: AgreementTables, deal_codes: Sequence[str], contact_type: str) -> DataFrame:
    """Everything around a deal: subscription, header, customer, addresses, contacts and groups."""
    deals = tables.offer_deal_codes.where(F.col("deal_code").isin(list(deal_codes)))
    contacts = tables.contact_details.where(F.col("contact_type") == contact_type)
    return (
        deals.select("deal_code", "inc_hdr_id", "account_subscription_id")
        .join(tables.account_subscriptions.select("account_subscription_id"), "account_subscription_id")
        .join(tables.inc_hdr.select("inc_hdr_id", "customer_profile_id", "status", "inc_name"), "inc_hdr_id")
        .join(tables.customer_profile.select("customer_profile_id", "customer_name"), "customer_profile_id")
        .join(tables.customer_address.select("customer_profile_id", "address_type", "address_line1", "city"), "customer_profile_id")
        .join(contacts.select("customer_profile_id", "contact_detail_id", "contact_type"), "customer_profile_id")
        .join(
            tables.contact_communication.select("contact_detail_id", "communication_type", "communication_value"), "contact_detail_id"
        )
        .join(tables.inc_agreement_group.select("inc_hdr_id", "expected_base_revenue"), "inc_hdr_id")
        .drop("customer_profile_id", "contact_detail_id", "account_subscription_id")
    )


def ticketing_agents(tables: AgreementTables, header_test: Column) -> DataFrame:
    """Agents of the headers that pass the test, highest header first."""
    agents = tables.inc_ticketing_agents.where(header_test)
    customers = tables.customer_profile.select("customer_profile_id", "customer_name")
    joined = agents.join(customers, agents["agent_profile_id"] == customers["customer_profile_id"])
    return joined.select("inc_hdr_id", "customer_name", "agent_profile_id").orderBy(F.desc_nulls_first("inc_hdr_id"))
