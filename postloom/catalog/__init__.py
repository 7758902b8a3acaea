"""Queries over the supplied tables, one or more per operator, with their SQL equivalents."""

from __future__ import annotations

from . import curation, features, labels, profiling, reports, sampling, storage, texts  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
