"""The queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import book_queries, features, figures, flow_queries, gate_queries, report_queries

MODULES = [flow_queries, book_queries, report_queries, figures, gate_queries, features]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
