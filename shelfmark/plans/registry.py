"""Queries by name, each with its SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from .derived import with_derived

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of (spark, sf_dir) under its own name."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_derived(sql)
        return f

    return put
