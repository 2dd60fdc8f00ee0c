"""The registered queries: each runs library operators over the given tables.

Every entry names the operators of the blueprint it covers; :func:`coverage` inverts that.
"""

from __future__ import annotations

from tidemark.queries import analysis, documents, events, features, forecasts, harness, sources  # noqa: F401
from tidemark.queries.registry import ENTRIES


def queries():
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql():
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def coverage() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, e in ENTRIES.items():
        for op in e.ops:
            out.setdefault(op, []).append(name)
    return out
