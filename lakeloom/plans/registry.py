"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

from lakeloom.plans import flow, lexical, retrieval

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (retrieval, lexical, flow):
    for _name, (_run, _sql) in _module.BOOK.items():
        QUERIES[_name] = _run
        if _sql:
            ORACLES[_name] = _sql
