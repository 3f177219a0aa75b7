"""Importing this module fills the catalogue."""
from newsgauge.plans import coverage_queries, framing_queries, quality_queries, relevance_queries, source_queries, survey_queries, text_queries  # noqa: F401
