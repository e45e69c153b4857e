"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("fields", "listings", "joins", "versions", "corpus", "streams")

QUERIES: dict = {}
ORACLES: dict = {}

for _name in MODULES:
    _module = importlib.import_module(f"prosopon.plans.{_name}")
    for _key, (_run, _sql) in _module.CATALOG.items():
        if _key in QUERIES:
            raise ValueError(f"query {_key} registered twice")
        QUERIES[_key] = _run
        if _sql is not None:
            ORACLES[_key] = _sql
