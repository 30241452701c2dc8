"""Registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from .plans import page_plans, place_plans, session_plans, store_plans, table_plans, text_plans  # noqa: F401  they register themselves
from .plans.catalog import QUERIES, SQL

FLAGSHIP = "article_stats"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
