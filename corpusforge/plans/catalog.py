"""All named queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from corpusforge.plans import retrieval_queries, rule_queries, text_queries

MODULES = (text_queries, retrieval_queries, rule_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
