"""The engine's queries by name, with their DuckDB equivalents."""

from __future__ import annotations

from . import capacity_queries, judging_queries, monitoring_queries, retrieval_queries, store_queries, text_queries, trained_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
