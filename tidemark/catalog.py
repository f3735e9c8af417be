"""All queries over the reviewed panel and their DuckDB counterparts."""

from __future__ import annotations

from tidemark.plans.oracle import oracle_sql
from tidemark.plans.review import queries

__all__ = ["oracle_sql", "queries"]
