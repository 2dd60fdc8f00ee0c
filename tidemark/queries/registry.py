"""Query registration and the SQL building blocks shared by the comparison queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    ops: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(ops: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name; ``ops`` lists the operator ids it covers."""

    def register(run: Run) -> Run:
        ENTRIES[run.__name__] = Entry(run, tuple(ops.split()), sql)
        return run

    return register
