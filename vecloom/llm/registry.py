"""Queries of this subpackage, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from vecloom.plans.catalog import Entry, Query

ENTRIES: dict[str, Entry] = {}

# Fixed value: one document in this many is held out of every fit.
FOLDS = 5


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add
