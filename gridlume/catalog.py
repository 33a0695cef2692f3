"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from gridlume.plans import flows, geo_queries, join_queries, pages, rollup_queries, scalar_queries, state_queries

_MODULES = (scalar_queries, rollup_queries, join_queries, geo_queries, state_queries, pages, flows)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in _MODULES for name, text in m.ORACLE_SQL.items()}
