"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from .sources.tables import whole_unions

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name; sql may start from the CTEs of `fixtures.cte`."""

    def put(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            whole_unions(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return put
