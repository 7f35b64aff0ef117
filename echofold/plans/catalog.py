"""All registered queries."""

from __future__ import annotations

from echofold.plans import compare_queries, fit_queries, pair_queries, signal_queries  # noqa: F401
from echofold.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
