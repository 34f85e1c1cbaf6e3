"""A small register that pairs queries with their SQL."""

from __future__ import annotations


class Register:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
