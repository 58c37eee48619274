"""All registered queries of the event operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import cohort_queries, model_queries, scoring_queries, source_queries, store_queries

_MODULES = (store_queries, cohort_queries, scoring_queries, model_queries, source_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
