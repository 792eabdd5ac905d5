"""A name -> callable registry; a name can be registered once."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.made: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def register(self, name: str, make: Callable, sql: str | None = None) -> None:
        if name in self.made:
            raise ValueError(f"{name} is registered already")
        self.made[name] = make
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.register(f.__name__, f, sql)
            return f

        return add

    def create(self, name: str, *args, **kw):
        if name not in self.made:
            raise KeyError(f"unknown name {name!r}; known: {', '.join(sorted(self.made))}")
        return self.made[name](*args, **kw)


QUERIES = Registry()
query = QUERIES.query
