"""All named queries."""

from __future__ import annotations

from tidemark.plans import queries, queries_reports  # noqa: F401  (registration)
from tidemark.plans.daily import release_runs
from tidemark.plans.queries import QUERIES
from tidemark.plans.study import release_studies


def start_cold() -> None:
    """Forget every stored stage of earlier queries."""
    release_runs()
    release_studies()


__all__ = ["QUERIES", "start_cold"]
