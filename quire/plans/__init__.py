"""Composite plans and the registry of named queries."""

from . import q_catalog, q_enrich, q_files, q_reports, q_sources, q_streams, q_text, q_triage  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
