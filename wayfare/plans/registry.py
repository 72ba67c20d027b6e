"""Registered queries: a name, a function of (spark, sf_dir) and, where SQL can say the same, DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from wayfare.sources.tables import tidy

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function; as a query, it leaves nothing in the shared folder but its result."""

    def add(f):
        QUERIES[name] = functools.wraps(f)(lambda spark, sf_dir: tidy(spark, lambda: f(spark, sf_dir)))
        if sql:
            SQL[name] = sql.strip()
        return f

    return add
