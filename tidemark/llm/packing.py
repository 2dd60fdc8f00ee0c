"""Mixture-controlled packing by deficit round-robin over source queues, in closed form.

Every source is a queue of its documents' tokens, cut into quanta.  In round-robin time ``v`` a source
of weight ``w`` has earned ``w * v`` quanta; its i-th quantum is served when its deficit (earned minus
served) reaches one half, at ``v = (i + 1/2) / w``.  Serving in the order of ``v`` is deficit
round-robin with deficits carried over windows without end, and as a quantum's rank is

    sum over queues of the quanta whose time is smaller (equal: the smaller queue number)

any task can tell it from the queues' totals alone: deficits carry over partitions without any
partition waiting for another.  The ranked quanta form one stream, windows are each ``window``
tokens of it, and the queues' last, shorter quanta follow at its end.  Only the last window is padded.

Weights default to the queues' own sizes, so that all end together and every window has the corpus's
proportions to within a quantum; with other targets a queue that ends leaves the rest their mutual
proportions.  A source with under ``1 / max_queues`` of the tokens that no target names shares one queue with
all such sources, so there are at most ``max_queues + 1`` queues and one for each target, whatever the input.

A window's tokens of a source differ from its share by at most two quanta.  The quantum is the largest power of two
that leaves the queue with the smallest share one quantum a window, and every window at least ``LEAST_QUANTA``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import read_ranks
from tidemark.llm.common import keyed, table_path
from tidemark.llm.token_counts import load
from tidemark.session import settled

PIECES = "doc_id {kind}, row_hash long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoder(tokenizer: str, ranks: str | None):
    """A function from a text to an array of its ids as the tokenizer's library gives them, special strings included.

    With a rank file of the same vocabulary, texts go through the library made for rank files, at a third of the
    time; special strings are taken from the tokenizer's own file.  A vocabulary that differs is refused.
    """
    encode = load(table_path(tokenizer))
    if ranks is None:
        return lambda text: np.array(encode.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import public_tokenizers
    import tiktoken

    added = {t.content: i for i, t in encode.get_added_tokens_decoder().items()}
    merges = read_ranks(table_path(ranks))
    if len(merges) + len(added) != encode.get_vocab_size() or any(i < len(merges) for i in added.values()):
        raise ValueError("the rank file has another vocabulary than the tokenizer")
    same = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added)
    return lambda text: same.encode_to_numpy(text, allowed_special="all")


def tokenised(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, row_hash, source, n, ids``: each document's ids and the end id, as little-endian 16-bit integers where the vocabulary fits, else 32-bit ones.

    Whole texts go to the library at once; a cache of the pieces between spaces took twice its time.
    """
    width = "<u2" if max(load(table_path(tokenizer)).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer, ranks), np.array([end_id], dtype=width).tobytes()
        for batch in slices(batches):
            out = [encode(text).astype(width).tobytes() + end for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row_hash": batch["row_hash"], "source": batch["source"], "n": [len(x) // int(width[-1]) for x in out], "ids": out})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, source_col, id_col=id_col, text_col=text_col).withColumnRenamed(source_col, "source")
    rows = rows.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    return rows.mapInPandas(run, f"doc_id {kind}, row_hash long, source string, n long, ids binary")


def slices(batches: Iterator[pd.DataFrame], rows: int = 500, room: int | None = None) -> Iterator[pd.DataFrame]:
    """The same rows, a few at a time, so that what is made of them stays small; with ``room`` about so many tokens (column ``n``) at most, or one longer document."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            some = batch.iloc[start : start + rows]
            full = np.flatnonzero(np.diff(np.cumsum(some["n"].to_numpy(dtype=np.int64)) // room)) + 1 if room else []
            for a, b in zip([0, *full], [*full, len(some)]):
                yield some.iloc[a:b].reset_index(drop=True)


#: Quanta of a window at least, however even the shares.
LEAST_QUANTA = 64


def quantum_for(window: int, shares: list[float]) -> int:
    """Tokens of a quantum, for the shares of the queues that are steered."""
    most = min(window * min(shares, default=1.0), window / LEAST_QUANTA)
    return 1 << max(int(most).bit_length() - 1, 0)


def whole_ratios(weights: list[Fraction] | list[float]) -> list[int]:
    """The weights, decimal numbers as written, as whole numbers in the same ratio."""
    exact = [Fraction(str(w)) for w in weights]
    common = math.lcm(*(w.denominator for w in exact))
    return [int(w * common) for w in exact]


class Schedule:
    """Where the quanta of every queue go in the common stream."""

    def __init__(self, tokens: list[int], weights: list[Fraction] | list[float] | None, quantum: int) -> None:
        self.quantum, self.tokens = quantum, np.array(tokens, dtype=np.int64)
        self.full = self.tokens // quantum
        #: Whole numbers in the ratio of the rates at which the queues are served.
        self.rates = self.full.tolist() if weights is None else whole_ratios(weights)
        rest = self.tokens - self.full * quantum
        self.tail = int(self.full.sum()) * quantum + np.r_[0, np.cumsum(rest)[:-1]] if len(rest) else rest

    def rank(self, queue: int, i: np.ndarray) -> np.ndarray:
        """Place among all full quanta of quanta ``i`` of a queue; quantum j of a queue of rate w is due at (2j + 1) / w, the smaller queue first."""
        out = np.zeros(len(i), dtype=np.int64)
        mine = self.rates[queue]
        for other in range(len(self.full)):
            n, rate = int(self.full[other]), self.rates[other]
            if other == queue:
                out += i
            elif n:
                # quanta j of the other queue due before, in whole numbers of any size
                large = (2 * int(self.full[queue]) + 1) * rate >= 1 << 62 or mine >= 1 << 62
                x = (2 * i + 1).astype(object if large else np.int64) * rate
                r = x // mine
                due = (r + 1) // 2
                if other > queue:
                    due = due - ((r * mine == x) & (r % 2 == 1))
                out += np.minimum(n, due).astype(np.int64)
        return out

    def quanta(self, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``document, i`` of every quantum that the documents lie in, by document."""
        first, last = begin // self.quantum, (begin + length - 1) // self.quantum
        n = last - first + 1
        return np.repeat(np.arange(len(n)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def places(self, queue: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place in the stream of quanta ``i`` of their queues."""
        out = np.empty(len(i), dtype=np.int64)
        for q in np.unique(queue).tolist():
            mine = np.flatnonzero(queue == q)
            own = i[mine]
            full = own < self.full[q]
            at = np.full(len(own), self.tail[q], dtype=np.int64)
            at[full] = self.rank(q, own[full]) * self.quantum
            out[mine] = at
        return out

    def pieces(self, queue: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``document, start, size, position`` of the runs that documents at ``begin`` of their queues are cut into; none crosses a window.

        All quanta of the documents go through each step together, not one document after the other.
        """
        q = self.quantum
        doc, i = self.quanta(begin, length)
        lo, hi = np.maximum(i * q, begin[doc]), np.minimum((i + 1) * q, (begin + length)[doc])
        at = self.places(queue[doc], i) + lo - i * q
        # windows cut quanta only in the tail or where the quantum does not divide the window
        first, last = at // window, (at + hi - lo - 1) // window
        n = last - first + 1
        k = np.repeat(np.arange(len(i)), n)
        w = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b = np.maximum(at[k], w * window), np.minimum((at + hi - lo)[k], (w + 1) * window)
        doc, start = doc[k], (lo - at)[k] + a - begin[doc[k]]
        joined = (a[1:] == b[:-1]) & (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
        heads = np.flatnonzero(np.r_[np.ones(min(len(a), 1), dtype=bool), ~joined])
        size = np.add.reduceat(b - a, heads) if len(a) else a
        return doc[heads], start[heads], size, a[heads]


def piece_ids(ids: list[bytes], tokens: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The ids of pieces as little-endian 32-bit integers, from all ids of their documents."""
    data = b"".join(ids)
    data = np.frombuffer(data, dtype="<u2" if len(data) == 2 * tokens.sum() else "<u4").astype("<u4").tobytes()
    begin = 4 * ((np.cumsum(tokens) - tokens)[doc] + start)
    return [data[a:b] for a, b in zip(begin.tolist(), (begin + 4 * size).tolist())]


def pack(docs: DataFrame, window: int = 1024, quantum: int | None = None, targets: dict[str, float] | None = None, max_queues: int = 500, bucket_rows: int = 2_000, with_ids: bool = True, **columns: str) -> DataFrame:
    """One row per piece: ``doc_id, row_hash, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``targets`` maps sources to weights (positive; sources not named get the weight of their size relative
    to all tokens).  Nulls and empty texts are a lone end id.  Null sources are one source.  Rows repeated in
    full are packed each: their pieces differ in place.  An empty table has no piece.  ``quantum`` follows the
    window and the shares (``quantum_for``) where it is not given.
    ``with_ids=False`` leaves the ids of the pieces null.
    """
    if window < 1 or (quantum is not None and quantum < 1) or any(not w > 0 for w in (targets or {}).values()):
        raise ValueError("window, quantum and weights must be positive")
    kind = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()
    rows = settled(tokenised(docs, **columns), "tokens")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most max_queues sources can hold more than 1 / max_queues of all tokens; a target has its own queue at any size
    sizes = rows.groupBy("source").agg(F.sum("n").alias("tokens"))
    wide = {r["source"]: r["tokens"] for r in sizes.where((F.col("tokens") * max_queues > total) | F.col("source").isin(list(targets or {}))).collect()}
    names = sorted(wide)
    rest = total - sum(wide.values())
    tokens = [wide[s] for s in names] + [rest]
    # a weight is the decimal number as written, so that all comparisons of the schedule are exact
    weights = None if targets is None else [Fraction(str(targets[s])) if s in targets else Fraction(max(wide[s], 1), max(total, 1)) for s in names] + [Fraction(max(rest, 1), max(total, 1))]
    if quantum is None:
        # a queue that holds less than its weight asks for still has it in every window until it ends
        steered = [w for w, n in zip(weights or tokens, tokens) if n]
        quantum = quantum_for(window, [float(w / sum(steered)) for w in steered[: len(steered) - (rest > 0)]])
    schedule = Schedule(tokens, weights, quantum)
    number = F.create_map(*[F.lit(x) for s, i in zip(names, range(len(names))) for x in (s, i)]) if names else F.create_map().cast("map<string,int>")
    buckets = max(1, -(-count // bucket_rows))
    placed = rows.withColumns({"queue": F.coalesce(F.get(F.map_values(number), F.lit(-1)) if not names else number[F.col("source")], F.lit(len(names))), "bucket": F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets)).cast("int")})
    # running totals in two steps: over the buckets of a queue, then inside each bucket; the window
    # over buckets sees one row per queue and bucket, that is 1 / bucket_rows of the documents
    sums = placed.groupBy("queue", "bucket").agg(F.sum("n").alias("inside"))
    before = F.coalesce(F.sum("inside").over(Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settled(sums.select("queue", "bucket", before.alias("before")), "starts")
    own = Window.partitionBy("queue", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "row_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = placed.hint("merge").join(starts, ["queue", "bucket"]).withColumn("begin", F.sum("n").over(own) - F.col("n") + F.col("before"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, room=2_000_000):
            queue, begin, n = (batch[c].to_numpy(dtype=np.int64) for c in ("queue", "begin", "n"))
            doc, start, size, at = schedule.pieces(queue, begin, n, window)
            ids = piece_ids(batch["ids"].tolist(), n, doc, start, size)
            crc = np.fromiter(map(zlib.crc32, ids), dtype=np.int64, count=len(ids))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].array.take(doc), "row_hash": batch["row_hash"].array.take(doc), "source": batch["source"].to_numpy(dtype=object)[doc], "start": start, "length": size, "ids_crc32": crc,
                "doc_tokens": n[doc], "sequence_id": at // window, "offset": at % window, "ids": pd.Series(ids if with_ids else None, index=range(len(doc)), dtype=object),
            })

    return queued.select("doc_id", "row_hash", "source", "queue", "begin", "n", "ids").mapInPandas(cut, PIECES.format(kind=kind))
