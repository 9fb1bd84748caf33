"""Whole jobs: child summaries, measures, the agreement search, lookups and payload extraction."""
