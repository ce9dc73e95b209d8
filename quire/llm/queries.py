"""Imports the operators, which register their queries."""

from . import (bpe, chat_format, exact_dedup, grid_join, hard_negatives, license_scan, near_dedup, packing, quality,
               spelling, suffix_dedup, token_files, vantage)  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
