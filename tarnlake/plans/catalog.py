"""Every registered query of the core library with its DuckDB twin."""

from __future__ import annotations

from tarnlake.plans import documents, evaluation, inputs, retrieval, sessions  # noqa: F401  importing a module registers its queries
from tarnlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
