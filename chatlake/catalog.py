"""Every query of the library."""

from __future__ import annotations

from .operators import clean, graph, index, ledger, models, scope, search, similar, tables, threads, vectors  # noqa: F401
from .plans import mapreduce, retrieval, upkeep  # noqa: F401
from .registry import QUERIES, SQL
from .sources import messages  # noqa: F401
from .streaming import ingest  # noqa: F401

__all__ = ["QUERIES", "SQL"]
