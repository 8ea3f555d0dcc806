"""All queries of the library."""

from __future__ import annotations

from loadflow.plans import queries_functions, queries_jobs, queries_metadata, queries_tables  # noqa: F401  they register themselves
from loadflow.plans.common import QUERIES, Query


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
