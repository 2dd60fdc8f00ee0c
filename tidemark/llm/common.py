"""What several operators share: the columns they read, row identity and bounded caches of worker processes."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def blank(column: str) -> Column:
    """Whether a text has no word."""
    return F.trim(F.col(column), F.lit(" \t\n\x0b\f\r")) == ""


def keyed(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, text`` and the columns named; ``row_hash`` tells rows apart that share an id."""
    text = text_of(text_col)
    extra = [F.col(c).alias(c) for c in more]
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"), *extra)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on row identity; ids that are null match each other."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_hash"] == b["row_hash"])


class Cache(dict):
    """``cache[key]`` computes a missing value once and keeps at most ``2 * room`` of them.

    Two generations: when the young one is full it becomes the old one, and what is used
    again moves back.  Hits cost one dictionary look-up; nothing is ever wrong, only computed again.
    """

    def __init__(self, compute: Callable[[Any], Any], room: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.room, self.longest, self.old = compute, room, longest, {}

    def __missing__(self, key: Any) -> Any:
        if key in self.old:
            value = self.old[key]
        else:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_TWO_BLANKS = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """Pieces between single spaces that have no blank on either side.

    The byte-level pattern always starts a new match at such a space, so a text's ids are those of
    the first piece followed by those of a space and each later piece.
    """
    return _LONE_SPACE.split(text) if _TWO_BLANKS.search(text) else text.split(" ")


def table_path(name: str) -> str:
    """Where a worker finds a public tokenizer's file: the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
