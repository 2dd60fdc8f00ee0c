"""Token counts by a two-tier look-up on the map side.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and their lengths, tier two
a bounded cache in each worker process that asks the tokenizer library for the rest, all that a slice
of rows lacks at once.  A pre-token here is a run between ASCII blanks: the tokenizer drops white
space and no token crosses it, so the lengths of a text's runs add up to its length.  No pre-token is shuffled.

The frequent table covers all documents: each task keeps a bounded frequency summary
(Misra-Gries: at ``room`` counters the smallest half is subtracted), and summaries are merged by
twos or more until one is left.  The table has at most ``table_size`` entries of at most 64
characters, hence its broadcast is bounded.  It only saves time; a run absent from it is encoded.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table_path, text_of

BLANKS = "\t\n\r\x0b\x0c"
LONGEST = 64
#: Stands between pre-tokens that are encoded together: alone it is one token of its own.
MARK = "\x01"


def pre_tokens(text: str) -> list[str]:
    for blank in BLANKS:
        text = text.replace(blank, " ")
    return text.split(" ")


def shrink(counts: Counter, room: int) -> Counter:
    """At most ``room`` counters: subtract the count of the first one that does not fit from all."""
    if len(counts) <= room:
        return counts
    top = counts.most_common(room + 1)
    cut = top[-1][1]
    return Counter({k: v - cut for k, v in top if v > cut})


def frequent(docs: DataFrame, text_col: str = "text", table_size: int = 32_768, fan_in: int = 16) -> dict[str, int]:
    """The most frequent pre-tokens of all documents with a lower bound of their counts."""
    room = table_size * 2

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for texts in by_size(batch["text"]):
                here: Counter = Counter()
                for text in texts:
                    here.update(pre_tokens(text))
                counts.update({w: n for w, n in here.items() if len(w) <= LONGEST})
                if len(counts) > 4 * room:
                    counts = shrink(counts, room)
        counts.pop("", None)
        yield pd.DataFrame({"summary": [json.dumps(shrink(counts, room))]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for summary in batch["summary"]:
                counts.update(json.loads(summary))
                counts = shrink(counts, room)
        yield pd.DataFrame({"summary": [json.dumps(counts)]})

    parts = docs.select(text_of(text_col).alias("text"))
    tasks, level = parts.rdd.getNumPartitions(), parts.mapInPandas(summarise, "summary string")
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        level = level.repartition(tasks).mapInPandas(merge, "summary string")
    rows = level.collect()  # one summary, or none of an empty table
    counts = Counter(json.loads(rows[0]["summary"])) if rows else Counter()
    return dict(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:table_size])


def load(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def by_size(texts: Iterable[str], room: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, some at a time: about ``room`` characters, or one longer text."""
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size > room:
            yield some
            some, size = [], 0
    if some:
        yield some


class Lengths:
    """Token lengths of pre-tokens: the broadcast table, then a cache of at most ``2 * room`` others, then the library.

    The cache has two generations; what is used again moves from the old one to the young one.
    Runs of more than ``LONGEST`` characters are encoded and not kept.
    """

    def __init__(self, library, known: dict[str, int], room: int = 150_000) -> None:
        self.library, self.known, self.room = library, {**known, "": 0}, room
        self.young = dict(self.known)
        self.old: dict[str, int] = {}
        mark = library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def encoded(self, runs: list[str]) -> list[int]:
        """Their lengths; one call for all where marks between them tell their tokens apart."""
        if self.mark is not None and runs and not any(MARK in r for r in runs):
            ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(runs)], add_special_tokens=False)[0].ids)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(runs) - 1:
                return (np.diff(np.r_[-1, cut, len(ids)]) - 1).tolist()
        return [len(self.library.encode(r, add_special_tokens=False).ids) for r in runs]

    def sums(self, texts: list[list[str]]) -> list[int]:
        """The length of each text, given as its pre-tokens."""
        lacking = set().union(*texts).difference(self.young)
        self.young.update({r: self.old[r] for r in lacking if r in self.old})
        fresh = list(lacking.difference(self.young))
        self.young.update(zip(fresh, self.encoded(fresh)))
        out = [sum(map(self.young.__getitem__, t)) for t in texts]
        for run in fresh:
            if len(run) > LONGEST:
                del self.young[run]
        if len(self.young) > self.room + len(self.known):
            self.old, self.young = self.young, dict(self.known)
        return out


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, as the tokenizer's library counts the whole text.

    Special strings inside texts are handled as by the library's default; no special tokens are
    added.  Nulls and empty texts have 0 tokens.  Rows repeated are counted each.
    """
    spark = docs.sparkSession
    encode = load(table_path(tokenizer)).encode
    known = {w: len(encode(w, add_special_tokens=False).ids) for w in frequent(docs, text_col)}
    table = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = Lengths(load(table_path(tokenizer)), table.value)
        for batch in batches:
            sums = [n for texts in by_size(batch["text"]) for n in lengths.sums([pre_tokens(t) for t in texts])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": sums})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    out = rows.mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
