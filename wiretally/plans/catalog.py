"""All registered queries."""
from __future__ import annotations

from wiretally.plans import chunk_queries, plan_queries, search_queries, index_queries, telemetry_queries, compliance_queries, store_queries

QUERIES, ORACLES = {}, {}
for module in (chunk_queries, plan_queries, search_queries, index_queries, telemetry_queries, compliance_queries, store_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
