"""All queries over the test tables and their SQL."""

from __future__ import annotations

from . import queries_episodes, queries_kernels, queries_metrics, queries_more, queries_volume  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
