"""How a module of checks names its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries, their SQL, and the decorator that fills both."""
    queries, oracles = {}, {}

    def query(name: str, oracle: str | None = None):
        def add(function):
            queries[name] = function
            if oracle:
                oracles[name] = oracle
            return function
        return add

    return queries, oracles, query
