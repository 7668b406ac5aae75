"""Registry of the queries and of their SQL."""

from __future__ import annotations

from quillon.plans import retrieval, stored, system, texts  # noqa: F401  (they register themselves)


def queries() -> dict:
    return dict(retrieval.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(retrieval.SQL)
