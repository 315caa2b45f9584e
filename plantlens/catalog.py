"""All queries of the engine with the SQL that checks them."""

from __future__ import annotations

from plantlens.plans import applied, assembled, checked, direct, graphs, numeric, relational, text
from plantlens.registry import Query

FLAGSHIP = "endpoint_status"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _registry in (text.REGISTRY, relational.REGISTRY, graphs.REGISTRY, numeric.REGISTRY, applied.REGISTRY, assembled.REGISTRY, checked.REGISTRY, direct.REGISTRY):
    QUERIES |= _registry.queries
    ORACLE_SQL |= _registry.sql
