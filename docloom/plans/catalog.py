"""Registry of the engine's named queries and of their SQL statements."""

from __future__ import annotations

from . import queries_agent, queries_answers, queries_derived, queries_eval, queries_index, queries_more, queries_search, queries_text  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

FLAGSHIP = "e10_metrics"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
