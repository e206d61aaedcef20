"""Queries by name, with the inventory entries they cover and the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(*covers: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
