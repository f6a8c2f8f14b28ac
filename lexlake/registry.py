"""Registry of the library's queries and of the SQL that checks them."""

from __future__ import annotations

from lexlake.plans import analytics, context, conversations, corpus, graph, pipelines, retrieval, text, versions  # noqa: F401  each registers its queries
from lexlake.plans.catalogue import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    """Query name to builder."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(ORACLE)
