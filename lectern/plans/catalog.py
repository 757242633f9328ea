"""All queries of the library by name, and the SQL that each must equal."""

from __future__ import annotations

from . import artifacts, preference, retrieval, statistics, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "artifacts", "preference", "retrieval", "statistics", "texts"]
