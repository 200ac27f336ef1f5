"""All queries over the base tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import loads, scorecards, streams, texts, traffic  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
