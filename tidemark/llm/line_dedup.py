"""Line deduplication by overlapping windows of three lines; DataFrame operations only.

Lines are the pieces between line feeds, compared without the blanks around them; lines without
any word are passed over when windows are formed, and stay.  Each three consecutive lines are
hashed to 128 bits.  A window's first occurrence, by document id, row hash and place, stays; the
lines that any later occurrence covers go.  A document of fewer than three worded lines has no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, same_row
from tidemark.session import settled

WIDTH = 3
#: Blanks around a line that do not count.
BLANKS = " \t\x0b\f\r"


def _fixed(column: Column, name: str) -> Column:
    """A generator of one row: keeps an array computed once instead of at each use."""
    return F.explode(F.array(column)).alias(name)


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    """``lines``: the text's lines; ``worded``: the places of those with a word."""
    cut = rows.select(*keep, _fixed(F.split("text", "\n", -1), "lines"))
    worded = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull())
    return cut.select(*keep, "lines", _fixed(worded, "worded"))


def windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, row_hash, place, k1, k2``: one row per window; ``place`` counts worded lines from 0."""
    line = lambda x: F.trim(x, F.lit(BLANKS))
    text = F.filter(F.split("text", "\n", -1), lambda x: line(x) != "")
    pairs = F.transform(text, lambda x: F.struct(F.xxhash64(line(x)).alias("a"), F.xxhash64(F.lit(1), line(x)).alias("b")))
    hashed = rows.select("doc_id", "row_hash", _fixed(pairs, "h")).where(F.size("h") >= width)
    shifted = F.arrays_zip(*[F.slice("h", F.lit(j + 1), F.size("h") - (width - 1)).alias(f"l{j}") for j in range(width)])
    each = hashed.select("doc_id", "row_hash", F.posexplode(shifted).alias("place", "w"))
    key = lambda part: F.xxhash64(*[F.col(f"w.l{j}.{part}") for j in range(width)])
    return each.select("doc_id", "row_hash", "place", key("a").alias("k1"), key("b").alias("k2"))


def repeated(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, row_hash, places``: where later occurrences of repeated windows begin."""
    every = settled(windows(rows, width), "windows")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash", "place")
    groups = every.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    # read back from files, both sides are plain shuffles: a window that a third of all documents share is split at run time
    groups = settled(groups, "repeated")
    later = every.join(groups.hint("merge"), ["k1", "k2"]).where(order != F.col("first"))
    return later.groupBy("doc_id", "row_hash").agg(F.collect_set("place").alias("places"))


def line_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, n_lines, n_removed, kept_text`` for every row.

    Rows repeated in full are one document.  Nulls and empty texts have one empty line, which stays.
    A text all of whose lines go becomes empty.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    found = settled(repeated(rows, width), "places")
    both = rows.join(found.hint("merge"), same_row(rows, found), "left").select(rows["doc_id"], rows["row_hash"], "text", "places")
    cut = _lines(both, "doc_id", "row_hash", "text", "places")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (width - 1)))))
    gone = F.coalesce(F.transform(covered, lambda j: F.get("worded", j)), F.array().cast("array<int>"))
    cut = cut.select("doc_id", "row_hash", "text", "lines", _fixed(gone, "gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = cut.select("doc_id", "row_hash", "text", "lines", "gone", _fixed(stay, "stay"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    return cut.select("doc_id", "row_hash", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept_text"))
