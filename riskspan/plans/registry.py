"""Registered queries and their oracle SQL."""

from . import code_queries, report_queries, series_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (series_queries, code_queries, report_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
