"""The registered queries of the engine's own operators."""

from __future__ import annotations

from tessera.plans import code_queries, graph_queries, log_queries, record_queries, review_queries, session_queries

MODULES = [record_queries, graph_queries, log_queries, code_queries, review_queries, session_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
