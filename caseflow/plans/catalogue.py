"""All queries of the engine and their SQL twins, by name."""

from __future__ import annotations

from caseflow.plans import archive_queries, event_queries, gap_queries, lineage_queries, probe_queries, provenance_queries, record_queries, review_queries, session_queries, text_queries  # noqa: F401
from caseflow.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
