"""Registered queries and the DuckDB statements they are checked against."""

from __future__ import annotations

from . import audit_queries, catalog_queries, conformity_queries, gradle_queries, scan_queries  # noqa: F401
from . import report_queries, scan_report_queries, scanner_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
