"""Query name -> callable, and query name -> SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

FLAGSHIP = "coverage"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
