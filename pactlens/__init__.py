"""Agreement analytics on Spark: search, measures, lookups, maintenance jobs and payload extraction."""

from pactlens.plans.search import SearchRequest, search_agreements
from pactlens.sources.tables import AgreementTables

__all__ = ["AgreementTables", "SearchRequest", "search_agreements"]
