"""Document quality rules with thresholds that adapt to each language and source.

Shares and word lengths are taken from every whole text.  Their distributions per (language, source) are
mergeable quantile sketches: histograms over buckets of 32 per power of two, so a quantile is exact to
one part in 32, sketches add by counts, and those of a language or of everything are sums of its parts.  Quartiles of
the sketches give fences; a document beyond any fence of its stratum is rejected.

A stratum sets its own fences from ``min_rows`` documents on, however large the table; smaller ones take those of
their language, then those of all documents.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed
from tidemark.session import settled

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Fixed values of the method: reach of the fences in interquartile halves, and the least such half,
#: in parts per million (word length: thousandths of a code point).
REACH = {"symbol_share": 6, "dup_line_share": 6, "repeat_share": 6, "word_length": 8}
LEAST_HALF = {"symbol_share": 5_000, "dup_line_share": 60_000, "repeat_share": 50_000, "word_length": 300}
TWO_SIDED = ("word_length",)

_random = random.Random(97)
_WEIGHTS = np.array([_random.getrandbits(64) | 1 for _ in range(WINDOW)], dtype=np.uint64)
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        key += h[j : j + n] * _WEIGHTS[j]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def stats_of(text: str) -> tuple[int, int, int, int, int, int]:
    """The six counts named in ``STATS``; lines are those with a word."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeat_words(words),
    )


def text_stats(rows: DataFrame, keep: str) -> DataFrame:
    """The columns of ``rows`` but ``text``, whose types ``keep`` gives, and the counts of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = pd.DataFrame([stats_of(t) for t in batch["text"]], columns=list(STATS), index=batch.index)
            yield pd.concat([batch.drop(columns="text"), stats], axis=1)

    return rows.mapInPandas(run, f"{keep}, " + ", ".join(f"{c} long" for c in STATS))


def metrics() -> dict[str, Column]:
    whole = lambda a, b, k: F.expr(f"({a} * {k}) div greatest({b}, 1L)")
    return {
        "symbol_share": whole("n_symbols", "word_chars", 1_000_000), "dup_line_share": whole("n_dup_lines", "n_lines", 1_000_000),
        "repeat_share": whole("n_repeat_words", "n_words", 1_000_000), "word_length": whole("word_chars", "n_words", 1_000),
    }


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: all but the six leading binary digits are cleared."""
    spare = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(stats: DataFrame) -> DataFrame:
    """``lang, source, metric, bucket, n``: the mergeable sketch of every stratum."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()])
    rows = stats.where(f"n_words >= {MIN_WORDS}").select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, min_rows: int = 100) -> DataFrame:
    """``level, lang, source, fence``: of large strata (level 2), large languages (1) and everything (0).

    ``fence`` maps a metric to its lowest and highest accepted value.
    """
    by_lang = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    total = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    level = lambda df, k, lang, source: df.select(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "metric", "bucket", "n")
    none = F.lit("")
    every = level(sketch, 2, F.col("lang"), F.col("source")).unionAll(level(by_lang, 1, F.col("lang"), none)).unionAll(level(total, 0, none, none))
    group = ["level", "lang", "source", "metric"]
    upto = Window.partitionBy(*group).orderBy("bucket")
    # a group of these windows has at most one row per bucket: 32 for each power of two
    ranked = every.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(Window.partitionBy(*group))})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, F.col("bucket")))
    found = ranked.groupBy(*group).agg(F.max("rows").alias("rows"), *[quartile(k).alias(f"q{k}") for k in (1, 2, 3)])
    named = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("metric")]
    reach, least = named(REACH), named(LEAST_HALF)
    low = F.when(F.col("metric").isin(*TWO_SIDED), F.col("q2") - reach * F.greatest(F.col("q2") - F.col("q1"), least)).otherwise(F.lit(-1))
    high = F.col("q2") + reach * F.greatest(F.col("q3") - F.col("q2"), least)
    pairs = F.map_from_entries(F.collect_list(F.struct("metric", F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")))))
    out = found.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), pairs.alias("fence"))
    return settled(out, "fences").where((F.col("level") == 0) | (F.col("rows") >= min_rows)).select("level", "lang", "source", "fence")


def verdicts(stats: DataFrame, fence: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``.

    Fences are as many as large strata, so they go to the documents by sort-merge joins, in which a partition
    that one stratum overfills is split; only the single row for everything is broadcast.
    """
    own = fence.where("level = 2").select(F.col("lang").alias("l2"), F.col("source").alias("s2"), F.col("fence").alias("f2"))
    lang = fence.where("level = 1").select(F.col("lang").alias("l1"), F.col("fence").alias("f1"))
    top = fence.where("level = 0").select(F.lit(0).alias("l0"), F.col("fence").alias("f0"))
    # one row per stratum: its own fences or those that stand in for them
    strata = stats.select("lang", "source").distinct()
    strata = strata.join(own.hint("merge"), (strata["lang"] == F.col("l2")) & (strata["source"] == F.col("s2")), "left")
    strata = strata.join(lang.hint("merge"), strata["lang"] == F.col("l1"), "left")
    strata = strata.withColumn("zero", F.lit(0)).join(F.broadcast(top), F.col("zero") == F.col("l0"), "left")
    strata = settled(strata.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.coalesce("f2", "f1", "f0").alias("fence")), "strata")
    out = stats.join(strata.hint("merge"), (stats["lang"] == F.col("of_lang")) & (stats["source"] == F.col("of_source")), "left")
    fence_of = F.col("fence")
    inside = F.lit(True)
    for name, value in metrics().items():
        inside = inside & F.coalesce(value.between(fence_of[name]["low"], fence_of[name]["high"]), F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(*stats.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return keyed(docs, lang_col, source_col, id_col=id_col, text_col=text_col).select("doc_id", "row_hash", "text", blank(lang_col).alias("lang"), blank(source_col).alias("source"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row: ``doc_id, row_hash, lang, source``, the counts, ``base_failed`` and ``kept``.

    Nulls and empty texts have no words and fail.  A null language or source is the same stratum as an empty one.
    Repeated rows count each and share one answer.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col, lang_col, source_col)
    stats = settled(text_stats(rows, f"doc_id {kind}, row_hash long, lang string, source string"), "stats")
    return verdicts(stats, fences(sketches(stats)))
