"""Every query of the core library with its DuckDB oracle, collected from the modules of this package."""

from __future__ import annotations

from quarrystone.plans import evidence, projections, records, retrieval, statistics, strategies, text, windows, workflow
from quarrystone.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (text, projections, retrieval, records, evidence, windows, statistics, workflow, strategies):
    for name, (run, sql) in module.queries.items():
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
