"""Registered queries of the core: name -> (session, data directory) -> rows, and their SQL."""

from __future__ import annotations

from quillstone.operators import diff
from quillstone.plans import pipeline_queries, registry_queries, retrieval_queries, text_queries

QUERIES: dict = {"p2_found": diff.p2_found} | retrieval_queries.QUERIES | text_queries.QUERIES | registry_queries.QUERIES | pipeline_queries.QUERIES
SQL: dict[str, str] = {"p2_found": diff.P2_FOUND} | retrieval_queries.SQL | text_queries.SQL | registry_queries.SQL | pipeline_queries.SQL
FLAGSHIP = "hybrid_search"
