"""Helper for modules that register queries."""

from __future__ import annotations

from collections.abc import Callable

Entry = tuple[Callable, "str | None"]


def registrar() -> tuple[dict[str, Entry], Callable]:
    """(catalog, decorator): the decorator files a query under its function's name with its SQL."""
    catalog: dict[str, Entry] = {}

    def query(sql: str | None = None):
        def add(run: Callable) -> Callable:
            catalog[run.__name__] = (run, sql)
            return run

        return add

    return catalog, query
