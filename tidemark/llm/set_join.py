"""Near-duplicates: SimHash fingerprints searched in BK-trees, and the Jaccard similarity of word shingles.

Fingerprints within 3 of 64 bits propose the first pairs (``simhash.links``); those whose whole sets of shingles are as
similar as wanted are linked.  What the fingerprints miss or leave apart is then joined exactly, so that every pair at or
above the threshold is connected and none below is linked.

All documents order their distinct shingles alike.  Two sets of similarity ``t`` or more share one of the first
``n - ceil(t * n) + 1`` shingles of either, so only these prefixes meet, by a join on the shingle, and no such pair
is missed.  The order has the *early* shingles first, three eighths of all hashes: those that one class found so far holds
alone, then the others by the number of sets that hold them, counted over the whole table in ``SLICES`` passes.
An early shingle held by one class meets nobody, and it alone fills most prefixes; unrelated documents that
have a few shingles in common by chance, whose pairs grow with the square of the table, therefore hardly meet.  Later
shingles, for sets with few early ones, follow by their hash, and those frequent in a sample of the documents come last.

Sizes and places rule pairs out first, then a sketch of each set: a bit for each of at least as many buckets as it has members,
1 where an odd number of members fall.  Bits that differ count members not shared, so a sketch never shows less than is
shared.  Only pairs left are compared in full, and only their texts are read again.

Rows with one set of shingles are one node.  Pairs are tried against one node of each shingle's group first; nodes that
are linked by then need no test against each other, and all pairs of a group that still cross components are tested after.
Documents whose prefixes share a shingle and are not linked by then cost the square of their number.

Shingles stand for their 64-bit hashes, sets for the hash of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keyed
from tidemark.llm.components import components
from tidemark.llm import simhash
from tidemark.llm.simhash import shingle_hashes
from tidemark.session import settled, temporary


#: Passes over the early shingles, and where each one's hashes end.
SLICES = 4
_ENDS = np.array([(k + 1) * 3 * 2**61 // SLICES for k in range(SLICES)], dtype=np.uint64)


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def in_order(hashes: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The hashes by their weight (0 where not common), then by value; ``hashes`` and ``common`` are sorted."""
    if not len(common) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.argsort(np.where(common[at] == hashes, weight[at], 0), kind="stable")]


def frequent(rows: DataFrame, width: int, sample_rows: int = 5_000, room: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more documents of a sample, at most ``room``, and their counts there."""
    every = max(1, rows.count() // sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": [shingle_set(t, width).view(np.int64) for t in batch["text"]]})

    drawn = rows.where(F.pmod(F.xxhash64("row_hash"), F.lit(every)) == 0).select("text")
    counts = drawn.mapInPandas(run, "h array<long>").select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    found = counts.orderBy(F.desc("n"), "h").limit(room).toPandas()
    values = found["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["n"].to_numpy(dtype=np.int64)[order]


def sketch(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the hashes fall into each bucket; a power of two of buckets, at least 64 and as many as hashes."""
    size = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_by_sketch(x: bytes, y: bytes, n: int, m: int) -> int:
    """What sets of ``n`` and ``m`` members share at most, given their sketches; the longer one is folded to the other's buckets."""
    a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return min(n, m, (n + m - int(np.bitwise_count(a ^ b).sum())) // 2)


def n_prefix(n: int, percent: int) -> int:
    """Of so many shingles the first that must hold one of those shared with a set as similar."""
    return n + (-n * percent // 100) + 1 if n else 0


def in_slices(hashes: np.ndarray, common: np.ndarray, weight: np.ndarray, percent: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The early shingles by slice of their hashes, and the later ones, in order, that the prefix takes where the early ones are too few."""
    ordered = in_order(hashes, common, weight)
    rare = len(hashes) if not len(common) else len(hashes) - int(np.isin(hashes, common, assume_unique=True).sum())
    ends = np.searchsorted(ordered[:rare], _ENDS)
    return np.split(ordered[: ends[-1]], ends[:-1]), ordered[ends[-1] : max(ends[-1], n_prefix(len(hashes), percent))]


def prefixes(rows: DataFrame, kind: str, width: int, percent: int) -> DataFrame:
    """``doc_id, row_hash, node, fp, n, bits, n_early, early0 ..., late``: the row's node and fingerprint, its number of shingles, their sketch, and what its prefix is taken from."""
    common, weight = frequent(rows, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [shingle_hashes(t, width) for t in batch["text"]]
            sets = [np.unique(np.array(h, dtype=np.uint64)) for h in every]
            fp = np.array([simhash.simhash(h) for h in every], dtype=np.uint64).view(np.int64)
            cut = [in_slices(s, common, weight, percent) for s in sets]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            own = {"doc_id": batch["doc_id"], "row_hash": batch["row_hash"], "node": node, "fp": fp, "n": [len(s) for s in sets], "bits": [sketch(s) for s in sets]}
            early = {f"early{k}": [e[k].view(np.int64) for e, _ in cut] for k in range(SLICES)}
            yield pd.DataFrame(own | {"n_early": [sum(map(len, e)) for e, _ in cut]} | early | {"late": [x.view(np.int64) for _, x in cut]})

    arrays = ", ".join(f"early{k} array<long>" for k in range(SLICES))
    return rows.select("doc_id", "row_hash", "text").mapInPandas(run, f"doc_id {kind}, row_hash long, node long, fp long, n int, bits binary, n_early int, {arrays}, late array<long>")


def _possible(percent: int) -> Column:
    """Whether sets of ``n`` and ``n2`` shingles whose first common one has the places ``pos`` and ``pos2`` can be as similar."""
    n, n2 = F.col("n").cast("long"), F.col("n2").cast("long")
    most = 1 + F.least(n - F.col("pos") - 1, n2 - F.col("pos2") - 1)
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & ((100 + percent) * most >= percent * (n + n2))


def _confirmed(pairs: DataFrame, marks: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are as similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "x": [shingle_set(t, width).tobytes() for t in batch["text"]]})

    with temporary(rows.sparkSession):
        pairs = settled(pairs.select("a", "b").distinct(), "pairs")
        sketches = marks.select("node", F.col("bits").alias("x"), "n").dropDuplicates(["node"])
        close = settled(_as_similar(pairs, sketches, most_by_sketch, percent), "close")
        if close.isEmpty():
            return settled(close, "confirmed", stay=True)
        asked = close.select(F.col("a").alias("node")).unionAll(close.select("b")).distinct()
        one = settled(marks.groupBy("node").agg(F.min("row_hash").alias("row_hash")).join(asked.hint("merge"), "node", "left_semi"), "asked")
        # rows of one hash have one text: one of each, where the join has put them side by side
        found = rows.select("row_hash", "text").join(one.hint("merge"), "row_hash").dropDuplicates(["row_hash"])
        sets = settled(found.select("node", "text").mapInPandas(run, "node long, x binary"), "sets").withColumn("n", (F.octet_length("x") / 8).cast("int"))
        return settled(_as_similar(close, sets, most_by_members, percent), "confirmed", stay=True)


def most_shared(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """What sets of ``n`` and ``m`` members share at most, given their different values; exact where no two members have one value."""
    return len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))


def most_by_members(x: bytes, y: bytes, n: int, m: int) -> int:
    return most_shared(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), n, m)


def _as_similar(pairs: DataFrame, sets: DataFrame, most: Callable[[bytes, bytes, int, int], int], percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets (``node``, ``x``, ``n``: members) can be as similar by what ``most`` says they share."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa"), F.col("n").alias("na")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb"), F.col("n").alias("nb")).hint("merge"), "b").select("a", "b", "xa", "na", "xb", "nb")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, n, y, m in zip(batch["xa"], batch["na"], batch["xb"], batch["nb"]):
                shared = most(x, y, n, m)
                keep.append(100 * shared >= percent * (n + m - shared))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return both.mapInPandas(test, "a long, b long")


def alike(marks: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes of one fingerprint, and of the fingerprints that BK-trees find within the radius."""
    prints = settled(marks.groupBy("fp").agg(F.min("node").alias("a")), "prints")
    same = marks.select("fp", F.col("node").alias("b")).join(prints.hint("merge"), "fp").where("a <> b").select("a", "b")
    near = simhash.links(prints.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("fp2"))
    near = near.join(prints.hint("merge"), "fp").join(prints.select(F.col("fp").alias("fp2"), F.col("a").alias("b")).hint("merge"), "fp2")
    return same.unionAll(near.where("a <> b").select("a", "b"))


def tokens(one: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, root, pos``: the shingles of each node's prefix that another class may hold, and their places in the node's order."""
    shared = None
    for k in range(SLICES):
        part = one.select("node", "root", F.explode(f"early{k}").alias("token"))
        held = part.groupBy("token").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token", "held")
        met = settled(part.select("node", "token").join(settled(held, "held").hint("merge"), "token"), "met")
        shared = met if shared is None else shared.unionAll(met)
    own = one.select("node", "n", "root", "n_early")
    node = Window.partitionBy("node")
    placed = shared.join(own.hint("merge"), "node").withColumn("alone", F.col("n_early") - F.count("*").over(node))
    placed = placed.withColumn("pos", (F.col("alone") + F.row_number().over(node.orderBy("held", "token")) - 1).cast("int"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    early = placed.where(F.col("pos") < first).select("token", "node", "n", "root", "pos")
    late = one.select("node", "n", "root", "n_early", F.posexplode("late").alias("at", "token"))
    return settled(early.unionAll(late.select("token", "node", "n", "root", (F.col("n_early") + F.col("at")).alias("pos"))), "tokens")


def links(marks: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: nodes linked so that all pairs of nodes at the threshold or above it are connected; each link is such a pair."""
    with temporary(rows.sparkSession):
        by_print = _confirmed(alike(marks), marks, rows, width, percent)
        with temporary(rows.sparkSession):
            roots = components(by_print)
            one = marks.select("node", "n", "n_early", *[f"early{k}" for k in range(SLICES)], "late").dropDuplicates(["node"]).join(roots.hint("merge"), "node", "left")
            one = settled(one.withColumn("root", F.coalesce("root", "node")), "one")
            token = tokens(one, percent)
            heads = token.groupBy("token").agg(F.min(F.struct("node", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
            heads = heads.select("token", F.col("head.node").alias("head"), F.col("head.root").alias("head_root"))
            shared = settled(token.join(heads.hint("merge"), "token"), "shared", stay=True)
        head = shared.where("node = head").select("token", F.col("node").alias("a"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
        star = shared.where("root <> head_root").join(head.hint("merge"), "token").where(_possible(percent)).select("a", F.col("node").alias("b"))
        first = by_print.unionAll(_confirmed(star, marks, rows, width, percent))
        roots = components(first).withColumnRenamed("root", "known")
        rooted = shared.drop("head", "head_root", "root").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known")
        with temporary(rows.sparkSession):
            rooted = settled(rooted, "rooted")
            open_ = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
            rest = settled(rooted.join(open_.hint("merge"), "token", "left_semi"), "rest", stay=True)
        other = rest.select("token", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"))
        cross = rest.join(other.hint("merge"), "token").where(F.col("node") < F.col("b")).where(F.col("root") != F.col("root2")).where(_possible(percent))
        return settled(first.unionAll(_confirmed(cross.select(F.col("node").alias("a"), "b"), marks, rows, width, percent)), "linked", stay=True)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, component_id, first_row`` for every row.

    Rows of similarity ``percent`` / 100 or more share a component, also through a chain; its id is the smallest
    ``doc_id`` in it (null only where all are), ``first_row`` whether the row is the one that stays:
    the smallest id, then the smallest row hash.  A text of fewer words is one shingle; null, empty and blank
    texts have none and are copies of each other.
    """
    if not 0 < percent <= 100:
        raise ValueError("the similarity must be over 0 and at most 100 percent")
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    with temporary(docs.sparkSession):
        marks = settled(prefixes(rows, kind, width, percent), "prefixes")
        order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash")
        nodes = settled(marks.groupBy("node").agg(F.min(order).alias("first")), "nodes")
        found = components(links(marks, rows, width, percent))
        rooted = settled(nodes.join(found.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
        firsts = settled(rooted.groupBy("root").agg(F.min("first").alias("first")), "firsts")
        classes = settled(rooted.select("node", "root").join(firsts.hint("merge"), "root").select("node", "first"), "classes")
        out = marks.select("doc_id", "row_hash", "node").join(classes.hint("merge"), "node").select("doc_id", "row_hash", F.col("first.doc_id").alias("component_id"), (order == F.col("first")).alias("first_row"))
        return settled(out, "near", stay=True)
