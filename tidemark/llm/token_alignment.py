"""Alignment of two tokenizers' outputs over the same bytes.

Tokenizer A is a byte-level BPE, tokenizer B a SentencePiece model that adds a space in front; both see
space + text.  Byte offsets where tokens of both end are found by galloping: the shorter list of ends drives an
exponential and then a binary search into the longer.  The common ends cut the tokens into groups, and inside a
group the ranks of a token's start and end among the other side's ends are the range of tokens it overlaps.

Neither tokenizer joins bytes across a lone space between two characters that are not blank (A starts a new match
there, no piece of B holds a space behind another character), so the text is aligned unit by unit and units met
before come from a bounded cache; the misses of a batch are encoded in one call each.

Counts over the corpus: documents are reduced to their different id pairs before any shuffle.  The ``hot`` most
frequent pairs (a fixed number) go to every task with their counts; what a document holds of other pairs is joined.

Every row is one document, also where rows repeat.  A text that is null, empty, or not given back byte by byte by
both tokenizers has no tokens: zeros and an empty string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table_path, text_of
from tidemark.session import settled, spread

_TWO_BLANKS = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def gallop(ends: np.ndarray, low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every ``x[i]`` the first index from ``low[i]`` on whose end is at least ``x[i]``, all at once: doubling steps, then a binary search in the last one."""
    n = len(ends)
    low, high, step = low.copy(), low.copy(), 1
    going = np.flatnonzero(high < n)
    going = going[ends[high[going]] < x[going]]
    while len(going):
        low[going] = high[going] + 1
        high[going] += step
        step *= 2
        going = going[high[going] < n]
        going = going[ends[high[going]] < x[going]]
    high = np.minimum(high, n)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = ends[middle] < x[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of equal ends on both sides; the shorter list drives the search in the longer.

    ``a_first`` and ``b_first`` give, for each token, the first token of the stretch it belongs to on the own side;
    stretches are numbered alike on both sides and the search begins at the stretch.
    """
    if len(a) > len(b):
        j, i = common_ends(b, a, b_first, a_first)
        return i, j
    own, other = np.unique(a_first), np.unique(b_first)
    at = gallop(b, other[np.searchsorted(own, a_first)], a)
    same = np.flatnonzero(at < len(b))
    same = same[b[at[same]] == a[same]]
    return same, at[same]


def overlaps(a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the first token of B that it overlaps and their number, from ranks; ``group_b`` is the first token of B in its group."""
    starts = np.concatenate([[0], a[:-1]]) if len(a) else a
    first = gallop(b, group_b, starts + 1)
    return first, gallop(b, first, a) - first + 1


def units(text: str) -> list[str]:
    """Stretches of space + text, each without its leading space, cut where neither tokenizer joins bytes."""
    if text[-1:] != " " and not _TWO_BLANKS.search(" " + text):
        return text.split(" ")
    head, *rest = _LONE_SPACE.split(" " + text)
    return [head[1:], *rest]


#: Token counts of A and B, number of groups, the groups as text, id pairs of all links.
Unit = tuple[int, int, int, str, np.ndarray]


class Pair:
    """Both tokenizers with the bytes of their tokens; ``b_size`` is B's vocabulary size."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.b_size = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, side)), dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        numbers = [str(i) for i in range(max(len(self.a_bytes), self.b_size))]
        self.written = np.array([[n + sign for n in numbers] for sign in (",", "|", ";", "\n")], dtype=object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts)

    def aligned(self, texts: list[str]) -> list[Unit | None]:
        """One record per text; ``None`` where the bytes are not those of space + text.

        The tokens of all texts are laid end to end and aligned at once.
        """
        a, b = self.encode(texts)
        data = [(" " + t).encode() for t in texts]
        good = _spelt(data, a, self.a_bytes) & _spelt(data, b, self.b_bytes)
        if not good.all():
            a, b = ([ids for ids, ok in zip(side, good) if ok] for side in (a, b))
        done = iter(self._units(a, b))
        return [next(done) if ok else None for ok in good]

    def _units(self, a: list[list[int]], b: list[list[int]]) -> Iterator[Unit]:
        if not a:
            return
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        i, j = common_ends(ends_a, ends_b, np.repeat(stop_a - n_a, n_a), np.repeat(stop_b - n_b, n_b))
        # group g holds the tokens from cut g on; every text ends with a cut
        cut_a, cut_b = np.concatenate([[0], i + 1]), np.concatenate([[0], j + 1])
        group_a, group_b = np.repeat(np.arange(len(i)), np.diff(cut_a)), np.repeat(np.arange(len(j)), np.diff(cut_b))
        first, many = overlaps(ends_a, ends_b, cut_b[group_a])
        left = np.repeat(ids_a, many)
        links = left * self.b_size + ids_b[np.arange(len(left)) + np.repeat(first - (np.cumsum(many) - many), many)]
        # per group A's ids, then B's; the sign after an id says what follows
        sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        sign_a[i], sign_b[j], sign_b[stop_b - 1] = 1, 2, 3
        said = np.empty(len(ids_a) + len(ids_b), dtype=object)
        said[np.arange(len(ids_a)) + cut_b[group_a]] = self.written[sign_a, ids_a]
        said[np.arange(len(ids_b)) + cut_a[group_b + 1]] = self.written[sign_b, ids_b]
        lines = "".join(said.tolist()).split("\n")
        ends = np.cumsum(many)[stop_a - 1].tolist()
        groups = np.diff(np.concatenate([[0], np.searchsorted(i, stop_a - 1, side="right")])).tolist()
        for x, y, g, line, low, high in zip(n_a.tolist(), n_b.tolist(), groups, lines, [0, *ends], ends):
            yield x, y, g, line, links[low:high]


def _spelt(data: list[bytes], ids: list[list[int]], table: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text join to its bytes; one comparison where all do."""
    parts = [b"".join(map(table.__getitem__, x)) for x in ids]
    return np.ones(len(data), bool) if parts == data else np.fromiter((x == y for x, y in zip(parts, data)), bool, len(data))


def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Aligns batches of texts; records of short units are kept, in two generations of at most ``room``."""

    def __init__(self, pair: Pair, room: int = 50_000, longest: int = 48) -> None:
        self.pair, self.room, self.longest = pair, room, longest
        self.young: dict[str, Unit | None] = {}
        self.old: dict[str, Unit | None] = {}

    def records(self, wanted: list[str]) -> list[Unit | None]:
        got = {}
        for u in wanted:
            if u in self.young:
                got[u] = self.young[u]
            elif u in self.old:
                got[u] = self.young[u] = self.old[u]
        missing = [u for u in wanted if u not in got]
        for u, record in zip(missing, self.pair.aligned(missing) if missing else []):
            got[u] = record
            if len(u) <= self.longest:
                self.young[u] = record
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        return [got[u] for u in wanted]

    def batch(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: token counts of A and B, groups, links, the groups as text, different id pairs and how often each is linked."""
        cut = [units(t) if t else [] for t in texts]
        wanted = list(dict.fromkeys(chain.from_iterable(cut)))
        number = {u: i for i, u in enumerate(wanted)}
        records = self.records(wanted)
        none = np.zeros(0, np.int64)
        bad = np.array([r is None for r in records], dtype=bool)
        records = [r or (0, 0, 0, "", none) for r in records]
        n_a, n_b, n_groups, said, links = zip(*records) if records else ((),) * 5
        sizes = np.array([n_a, n_b, n_groups, list(map(len, links))], dtype=np.int64).reshape(4, -1).T
        flat = np.concatenate([*links, none])
        first = np.cumsum(sizes[:, 3]) - sizes[:, 3]
        for pieces in cut:
            codes = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
            if not pieces or bad[codes].any():
                yield 0, 0, 0, 0, "", none, none
                continue
            totals = sizes[codes].sum(axis=0).tolist()
            kinds, times = np.unique(codes, return_counts=True)
            lengths = sizes[kinds, 3]
            at = np.arange(lengths.sum()) + np.repeat(first[kinds] - (np.cumsum(lengths) - lengths), lengths)
            pairs, where = np.unique(flat[at], return_inverse=True)
            weights = np.bincount(where, weights=np.repeat(times, lengths), minlength=len(pairs)).astype(np.int64)
            yield *totals, ";".join(map(said.__getitem__, codes.tolist())), pairs, weights


def slices(lengths: list[int], most: int, chars: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of at most ``most`` texts with at most ``chars`` characters together; a longer text is a run of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == most or total + n > chars):
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", with_groups: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk: int = 2_048, chars: int = 4_000_000) -> DataFrame:
    """``doc_id``, counts, ``groups`` (null without ``with_groups``), ``groups_sha256``, and the document's different ``pairs``
    (A's id times B's vocabulary size plus B's id) with the ``times`` each is linked.

    ``groups`` lists ids as ``a1,a2|b1;a3|b2,b3``.  A task aligns up to ``chunk`` texts at once, fewer where they have more than ``chars``
    characters together (a longer text goes alone): what texts share is then looked up once.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(Pair(table_path(a), table_path(b)))
        for whole in batches:
            for at, end in slices(whole["text"].map(len).tolist(), chunk, chars):
                batch = whole.iloc[at:end]
                rows = list(aligner.batch(batch["text"].tolist()))
                out = pd.DataFrame([r[:4] for r in rows], columns=["n_a", "n_b", "n_groups", "n_links"], dtype="int64")
                out.insert(0, "doc_id", batch["doc_id"].to_numpy())
                out["groups"] = pd.Series([r[4] if with_groups else None for r in rows], dtype=object)
                out["groups_sha256"] = pd.Series([hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "" for r in rows], dtype=object)
                out["pairs"], out["times"] = pd.Series([r[5] for r in rows], dtype=object), pd.Series([r[6] for r in rows], dtype=object)
                yield out

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return spread(texts).mapInPandas(run, f"doc_id {kind}, {_COUNTS}, groups string, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """``pair, n_docs, best``: documents that hold a pair linked, and whether no pair of its A id is held by more.

    The highest counts have one row per id of A, so they are broadcast: their number is A's vocabulary size.
    """
    counts = settled(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pair_counts")
    a_id = F.floor(F.col("pair") / F.lit(b_size))
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("n_docs").alias("top"))
    joined = counts.withColumn("a_id", a_id).join(F.broadcast(top), "a_id")
    return joined.select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def alignment_counts(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", hot: int = 1 << 16, **columns: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    ``count_sum`` adds up, over links, how many documents hold the link's id pair; ``n_best`` counts links whose pair
    is held by as many documents as any pair of the same A id.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=table_path(b)).vocab_size()
    found = settled(aligned(docs, a, b, with_groups=False, **columns).drop("groups"), "aligned")
    counts = settled(pair_counts(found, b_size), "pair_best")
    first = counts.orderBy(F.desc("n_docs"), "pair").limit(hot).toPandas().sort_values("pair")
    keys, n_docs, best = first["pair"].to_numpy(np.int64), first["n_docs"].to_numpy(np.int64), first["best"].to_numpy(bool)
    kind = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["pairs"].map(len).to_numpy(np.int64)
            pairs = np.concatenate([*batch["pairs"], np.zeros(0, np.int64)]).astype(np.int64)
            times = np.concatenate([*batch["times"], np.zeros(0, np.int64)]).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), lengths)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            total, chosen = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, row[hit], times[hit] * n_docs[at[hit]])
            np.add.at(chosen, row[hit], times[hit] * best[at[hit]])
            ends = np.cumsum(np.bincount(row[~hit], minlength=len(batch)))[:-1]
            out = batch.drop(columns=["pairs", "times"])
            out["n_best"], out["count_sum"] = chosen, total
            out["rare"], out["rare_times"] = np.split(pairs[~hit], ends) if len(batch) else [], np.split(times[~hit], ends) if len(batch) else []
            yield out

    part = found.mapInPandas(run, f"doc_id {kind}, {_COUNTS}, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    part = settled(part.withColumn("row", F.monotonically_increasing_id()), "aligned_hot")
    rest = part.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    more = rest.join(counts.hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = part.drop("rare", "rare_times").join(more.hint("merge"), "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
