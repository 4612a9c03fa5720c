"""How plan modules register a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries by name, SQL by name, and the decorator that fills both."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return queries, oracle, query
