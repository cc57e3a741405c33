"""All registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from siftwell.plans import codemap, context, contracts, functions, history, ingest, planning, savings, search, state

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (ingest, search, savings, codemap, planning, contracts, context, functions, state, history):
    QUERIES |= _module.CATALOG.queries
    ORACLE_SQL |= _module.CATALOG.sql
