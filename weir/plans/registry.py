"""The queries and their SQL by name; modules of this package add to it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register
