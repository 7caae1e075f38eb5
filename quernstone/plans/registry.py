"""All queries of the library proper, and their SQL, by name."""

from __future__ import annotations

from . import aggregates, clicks, joins, scalar, shapes, surfaces, tpch  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
