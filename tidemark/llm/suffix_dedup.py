"""Removal of long repeated byte strings, by longest-previous-factor arrays.

A byte goes when a string of ``length`` (200) bytes that covers it occurs elsewhere too: all such
strings, or with ``keep="first"`` all but the first by document id, row hash and place.

No suffix array of the corpus is built in one place.  Each string of 200 bytes is named by the
smallest hash of its 32-byte pieces, its anchor; neighbouring strings share an anchor, so a document
falls into runs of about 85 strings, and equal strings always have equal anchors.  Only anchors met twice matter:

1. runs that are equal as a whole (hash of all their bytes) repeat in every string, without a look at the text;
2. of anchors that have different runs, one representative of each different run goes to a shard of a few
   thousand runs.  Runs are narrowed there to the strings that may be equal, then the shard's suffix array, common
   prefixes, and previous and next smaller positions give each string's longest earlier and later match;
3. an anchor with too many different runs for one shard is settled by halving instead: strings are grouped in
   segments around the anchor; a segment whose common core is unique has no repeat, one whose core occurs only
   within equal whole segments repeats in every string, the others are cut in four, down to single strings, compared by hash.

All three are exact but for 128-bit hash collisions, and none holds more than a bounded part of a group in a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blank, keyed, same_row, text_of
from tidemark.llm.suffix_array import Suffixes, previous_factors
from tidemark.session import settled

PIECE = 32
_BLOCK = 2_000_000
_POS = 23
_rng = np.random.default_rng(20_011)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes from each position on."""
    h = _BYTE[data]
    size = 1
    for mix in _MIX[:5]:
        h = h[:-size] * mix + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX[5]
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``lo, hi, anchor hash, anchor position`` of runs of neighbouring valid string starts with one anchor."""
    h = piece_hashes(data)
    low = (h & ~np.uint64((1 << _POS) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - PIECE + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low[valid] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    last = np.r_[cut[1:], len(at)] - 1
    return valid[cut], valid[last], h[at[cut]].view(np.int64), at[cut]


def _blocks(texts: list[bytes], length: int):
    """Texts joined to about two million bytes, longer ones in overlapping parts: ``(joined, row, begin, size)`` arrays."""
    joined, row, begin = [], [], []
    total = 0
    for k, text in enumerate(texts):
        for start in range(0, max(len(text) - length + 1, 0), _BLOCK):
            part = text[start : start + _BLOCK + length - 1]
            if total and total + len(part) > _BLOCK:
                yield joined, row, begin
                joined, row, begin, total = [], [], [], 0
            joined.append(part)
            row.append(k)
            begin.append(start)
            total += len(part)
    if joined:
        yield joined, row, begin


def signatures(rows: DataFrame, length: int) -> DataFrame:
    """``doc_id, row_hash, lo, hi, pos, anchor, whole`` for every run of every row; ``whole`` hashes all bytes of the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, marks = batch["doc_id"].array, batch["row_hash"].array
            for parts, row, begin in _blocks([t.encode() for t in batch["text"]], length):
                text = b"".join(parts)
                size = np.array([len(p) for p in parts])
                base = np.cumsum(size) - size
                n = size - length + 1
                valid = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
                lo, hi, anchor, pos = runs(np.frombuffer(text, dtype=np.uint8), valid, length)
                view, digest = memoryview(text), xxhash.xxh3_64_intdigest
                whole = np.array([digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())], dtype=np.uint64).view(np.int64)
                k = np.searchsorted(base, lo, side="right") - 1
                shift = np.array(begin)[k] - base[k]
                own = np.array(row)[k]
                yield pd.DataFrame({"doc_id": ids[own], "row_hash": marks[own], "lo": lo + shift, "hi": hi + shift, "pos": pos + shift, "anchor": anchor, "whole": whole})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, row_hash long, lo long, hi long, pos long, anchor long, whole long")


ORDER = ("doc_id", "row_hash", "lo")
RANGES = "array<struct<a:bigint,b:bigint>>"


def segments(lo: int, hi: int, pos: int, data: bytes, length: int, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``segment, g1, g2, core`` for the segments of a run: g counts string starts back from the anchor, segment s holds g in [s * size, s * size + size).

    Of these g1 to g2 are the run's.  The core is what all strings of the segment would cover, so equal strings lie in segments of equal cores.
    """
    at, least, most = pos - lo, pos - hi, pos - lo
    for s in range(least // size, most // size + 1):
        yield s, max(s * size, least), min(s * size + size - 1, most), data[at - s * size : at - (s * size + size - 1) + length]


def narrowed(contexts: pd.DataFrame, length: int, size: int = 32) -> pd.DataFrame:
    """The runs of a shard cut down to the strings from the first to the last segment whose core another run has too.

    ``lo, hi`` and ``bytes`` are the narrower run's.  Strings beyond share no core, hence are equal to none.
    """
    cut = [list(segments(lo, hi, pos, data, length, size)) for lo, hi, pos, data in zip(contexts["lo"], contexts["hi"], contexts["pos"], contexts["bytes"])]
    anchors = contexts["anchor"].tolist()
    count = Counter((anchor, s, core) for anchor, parts in zip(anchors, cut) for s, _, _, core in parts)
    which, lows, highs = [], [], []
    for k, (anchor, pos, parts) in enumerate(zip(anchors, contexts["pos"].tolist(), cut)):
        shared = [(g1, g2) for s, g1, g2, core in parts if count[anchor, s, core] > 1]
        if shared:
            which.append(k)
            lows.append(pos - shared[-1][1])
            highs.append(pos - shared[0][0])
    kept = contexts.iloc[which]
    data = [x[a - lo : b - lo + length] for x, lo, a, b in zip(kept["bytes"], kept["lo"], lows, highs)]
    return kept.assign(lo=lows, hi=highs, bytes=data)


def shard_matches(contexts: pd.DataFrame, length: int, first: bool) -> pd.DataFrame:
    """``doc_id, row_hash, a, b``: ranges of string starts (both included) that have a match in another run of the shard (``first``: an earlier one)."""
    contexts = narrowed(contexts.sort_values(["z", "doc_id", "row_hash", "lo"]), length)
    texts = contexts["bytes"].tolist()
    size = np.array([len(t) for t in texts], dtype=np.int64)
    base, n = np.cumsum(size) - size, size - length + 1
    starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
    earlier, later = previous_factors(Suffixes(b"".join(texts), length), starts, length)
    hit = np.flatnonzero((earlier if first else np.maximum(earlier, later)) >= length)
    own = np.repeat(np.arange(len(n)), n)[hit]
    head = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (own[1:] != own[:-1])]) if len(hit) else hit
    tail = np.r_[head[1:], len(hit)] - 1 if len(hit) else hit
    at = contexts["lo"].to_numpy(dtype=np.int64)[own] + starts[hit] - base[own]
    found = contexts.iloc[own[head]]
    return pd.DataFrame({"doc_id": found["doc_id"].array, "row_hash": found["row_hash"].array, "a": at[head], "b": at[tail]})


def _hot_matches(contexts: DataFrame, length: int, first: bool) -> DataFrame:
    """As :func:`shard_matches`, for anchors with any number of different runs; ``contexts`` is a table in files."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    out = None
    open_ = contexts.select("anchor", "whole", F.lit(None).cast("array<long>").alias("segments"))
    for size in (64, 16, 4, 1):
        todo = contexts.join(open_, ["anchor", "whole"])

        def cut(batches: Iterator[pd.DataFrame], size: int = size) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = []
                for r in batch.itertuples(index=False):
                    at, inside = r.pos - r.lo, None if r.segments is None else set(r.segments)
                    for s, g1, g2, core in segments(r.lo, r.hi, r.pos, r.bytes, length, size):
                        if inside is None or s // 4 in inside:
                            union = r.bytes[at - g2 : at - g1 + length]
                            made.append((r.anchor, r.whole, s, g1, g2, xxhash.xxh3_128_digest(core), xxhash.xxh3_128_digest(union), r.doc_id, r.row_hash, r.lo, r.pos))
                yield pd.DataFrame(made, columns=["anchor", "whole", "segment", "g1", "g2", "core", "span", "doc_id", "row_hash", "lo", "pos"])

        kinds = f"anchor long, whole long, segment long, g1 long, g2 long, core binary, span binary, doc_id {kind}, row_hash long, lo long, pos long"
        every = settled(todo.mapInPandas(cut, kinds), "segments")
        order = F.struct(F.col("doc_id").isNull().alias("z"), *ORDER)
        cores = settled(every.groupBy("anchor", "segment", "core").agg(F.count("*").alias("n_core")).where("n_core > 1"), "cores")
        spans = settled(every.groupBy("anchor", "g1", "g2", "span").agg(F.count("*").alias("n_span"), F.min(order).alias("earliest")), "spans")
        judged = every.join(cores, ["anchor", "segment", "core"]).join(spans, ["anchor", "g1", "g2", "span"])
        # a segment is settled as a whole only with all that share its core, else the others would miss it further down
        alike = (F.col("n_span") > 1) & (F.col("n_span") == F.col("n_core"))
        judged = settled(judged.withColumn("alike", alike | F.lit(size == 1)), "judged")
        repeats = judged.where("alike and n_span > 1")
        if first:
            repeats = repeats.where(order != F.col("earliest"))
        mine = repeats.select("doc_id", "row_hash", (F.col("pos") - F.col("g2")).alias("a"), (F.col("pos") - F.col("g1")).alias("b"))
        out = mine if out is None else out.unionAll(mine)
        open_ = settled(judged.where("not alike").groupBy("anchor", "whole").agg(F.collect_list("segment").alias("segments")), "open")
        if size == 1 or open_.isEmpty():
            return out


def repeated_spans(rows: DataFrame, length: int = 200, keep: str | None = None, shard_runs: int = 4_000) -> DataFrame:
    """``doc_id, row_hash, spans``: byte ranges ``{a, b}`` (end excluded, they may overlap) to remove from each row that has any."""
    first = keep == "first"
    every = settled(signatures(rows, length), "runs")
    anchors = every.groupBy("anchor").agg(F.count("*").alias("n_anchor"), F.min("whole").alias("w1"), F.max("whole").alias("w2")).where("n_anchor > 1")
    anchors = settled(anchors.select("anchor", (F.col("w1") == F.col("w2")).alias("alike")), "anchors")
    again = settled(every.join(anchors.hint("merge"), "anchor"), "again")
    order = F.struct(F.col("doc_id").isNull().alias("z"), *ORDER, "hi", "pos")
    different = settled(again.groupBy("anchor", "whole", "alike").agg(F.count("*").alias("n"), F.min(order).alias("r")), "different")
    copied = again.join(different.where("n > 1").select("anchor", "whole", "r").hint("merge"), ["anchor", "whole"])
    if first:
        copied = copied.where(order != F.col("r"))
    whole = copied.select("doc_id", "row_hash", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    # one representative of each run, of the anchors that have several
    mixed = different.where("not alike")
    several = settled(mixed.groupBy("anchor").agg(F.count("*").alias("m")), "several")
    mixed = mixed.join(several.hint("merge"), "anchor").select("anchor", "whole", "n", "m", "r.z", "r.doc_id", "r.row_hash", "r.lo", "r.hi", "r.pos")
    wanted = mixed.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("anchor", "whole", "n", "m", "lo", "hi", "pos")).alias("runs"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for doc_id, row_hash, text, wanted_ in batch.itertuples(index=False):
                data = text.encode()
                made += [(doc_id, row_hash, r["anchor"], r["whole"], r["n"], r["m"], r["lo"], r["hi"], r["pos"], data[r["lo"] : r["hi"] + length]) for r in wanted_]
            yield pd.DataFrame(made, columns=["doc_id", "row_hash", "anchor", "whole", "n", "m", "lo", "hi", "pos", "bytes"])

    wanted = settled(wanted, "wanted")
    kind = rows.schema["doc_id"].dataType.simpleString()
    picked = rows.join(wanted.hint("merge"), same_row(rows, wanted)).select(rows["doc_id"], rows["row_hash"], "text", "runs")
    contexts = picked.mapInPandas(fetch, f"doc_id {kind}, row_hash long, anchor long, whole long, n long, m long, lo long, hi long, pos long, bytes binary")
    contexts = settled(contexts.dropDuplicates(["anchor", "whole"]), "contexts")
    cool, hot = contexts.where(F.col("m") <= shard_runs), contexts.where(F.col("m") > shard_runs)
    shards = max(1, -(-cool.count() // shard_runs))
    sharded = cool.withColumns({"z": F.col("doc_id").isNull(), "shard": F.pmod(F.xxhash64("anchor"), F.lit(shards))})
    matched = sharded.groupBy("shard").applyInPandas(lambda x: shard_matches(x, length, first), f"doc_id {kind}, row_hash long, a long, b long")
    if not hot.isEmpty():
        matched = matched.unionAll(_hot_matches(hot, length, first))
    parts = matched.select("doc_id", "row_hash", "a", (F.col("b") + length).alias("b"))
    return whole.unionAll(parts).groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal ranges of a set of ranges; those that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 200, keep: str | None = None, id_col: str = "doc_id", text_col: str = "text", **more: int) -> DataFrame:
    """``doc_id, row_hash, n_bytes, n_removed, spans, kept`` (binary) for every row; ``spans`` are maximal removed ranges.

    ``keep=None`` removes every occurrence of a repeated string, ``keep="first"`` all but the first.
    Nulls count as empty.  Rows repeated in full are copies of each other: without ``keep`` both lose what
    they share, with ``"first"`` both stay alike.  Texts shorter than ``length`` bytes stay.
    """
    if keep not in (None, "first") or length < 2 * PIECE:
        raise ValueError(f"keep is None or 'first', length at least {2 * PIECE}")
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    found = settled(repeated_spans(rows, length, keep, **more), "spans")
    both = rows.join(found.hint("merge"), same_row(rows, found), "left").select(rows["doc_id"], rows["row_hash"], "text", "spans")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, spans in zip(batch["text"], batch["spans"]):
                data = text.encode()
                gone = merged((s["a"], s["b"]) for s in spans) if spans is not None else []
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                made.append((len(data), sum(b - a for a, b in gone), [{"a": a, "b": b} for a, b in gone], b"".join(kept)))
            yield pd.concat([batch[["doc_id", "row_hash"]], pd.DataFrame(made, columns=["n_bytes", "n_removed", "spans", "kept"], index=batch.index)], axis=1)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInPandas(strip, f"doc_id {kind}, row_hash long, n_bytes long, n_removed long, spans {RANGES}, kept binary")


def inside_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without the parts of characters that it cuts at its ends."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """The rows with all their columns, their texts without later copies of repeated strings (the first one stays).

    A row of which no word is left goes.  Characters cut at the ends of a removed range stay whole, so texts remain valid.  A column ``n_chars`` is counted
    anew where the text changes.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    found = settled(repeated_spans(rows, length, "first"), "spans")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row_hash"))
    both = own.join(found.hint("merge"), same_row(own, found), "left").select("row", "spans")

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if s is None or not len(s):
                out.append(t)
                continue
            data, at, kept = t.encode(), 0, []
            for a, b in merged((x["a"], x["b"]) for x in s):
                a, b = inside_characters(data, a, b)
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append(b"".join(kept).decode())
        return pd.Series(out, dtype=object)

    new = both.withColumn("new", strip(F.col(f"row.`{text_col}`"), F.col("spans")))
    new = new.where(F.col("spans").isNull() | ~blank("new"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return new.select(*out)
