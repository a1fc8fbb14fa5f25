"""All queries of the engine and their SQL twins, collected from the plan modules."""

from __future__ import annotations

from . import corpus, details, evaluation, files, quantization, runs, windowing  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
