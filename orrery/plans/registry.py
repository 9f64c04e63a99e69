"""How modules of queries collect them with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry(queries: dict, oracle_sql: dict) -> Callable:
    """A decorator that takes the SQL (None where it can't express the query) and adds the function under its name."""

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle_sql[f.__name__] = sql
            return f

        return add

    return query
