"""The trie of conversation prefixes by truncation peeling.

A node is a distinct sequence of first turns; its key is a 128-bit digest chained over the turns, so a conversation's
path is the string of the keys of its prefixes and sorting by path puts every subtree side by side.

Conversations that end at the same node become one row first; their ids are joined in pieces of bounded size and hashed
as a stream, so a conversation with very many copies never stands in one array.  The rows are range-partitioned by path,
which also spreads a first turn that many conversations share.  Each slice (one Arrow batch of the sorted rows) is peeled:
from its greatest depth down, conversations that end at a depth join the nodes that survived from below, every node
loses its last turn, and what is then equal is one node of the next depth.  Counts, leaves and savings are complete when a node
is met.  Only the nodes on a slice's first and last path may go on in a neighbour.  They are at most two paths a slice; their parts are
added up by key, and what an open node owes its open ancestors is summed along one path that owns it, so depth costs no rounds.

Defined results: null roles and texts are empty; turns with a null conversation are left out; turns come by number, nulls
first, ties by the digest of role and text, and repeated turns stay; an empty table has no node.  A conversation is a row
of 20 bytes a turn, texts are not gathered.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import settled

WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation the digests of role and text and the code points of the text, in order of turn."""
    role, text = text_of("role"), text_of("text")
    said = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(F.col("turn"), F.substring(F.unhex(said), 1, WIDTH).alias("digest"), F.char_length(text).alias("chars"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(ordered: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """``conv_id, turns`` with the first ``h`` turns taken from the conversation that opens the block of ids; ``h`` is crc32 of the id modulo ``most + 1``.  Remainders of negative ids are negative, as in SQL."""
    opener = F.col("conv_id") - F.col("conv_id") % block
    heads = ordered.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("opener"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = ordered.withColumn("opener", opener).join(heads.hint("merge"), "opener", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


_PATH = "path binary, chars array<int>"


def ended(ordered: DataFrame, piece: int = 512) -> DataFrame:
    """``path, chars, n, low, ends``: one row per distinct whole conversation, with the hash of the ids of its copies."""

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            for digests in batch["digests"]:
                key, keys = b"", []
                for d in digests:
                    key = hashlib.blake2b(key + d, digest_size=WIDTH).digest()
                    keys.append(key)
                paths.append(b"".join(keys))
            yield pd.DataFrame({"conv_id": batch["conv_id"], "end": [p[-WIDTH:] for p in paths], "path": paths, "chars": batch["chars"]})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None
        for batch in batches:
            done = []
            for end, path, chars, n, low, ids in zip(*(batch[c] for c in ("end", "path", "chars", "n", "low", "ids"))):
                if held is not None and held[0] == end:
                    held[3] += n
                    held[5].update(("," + ids).encode())
                    continue
                if held is not None:
                    done.append(held)
                held = [end, path, chars, n, low, hashlib.sha256(ids.encode())]
            yield _rows(done)
        yield _rows([held] if held is not None else [])

    def _rows(done: list) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[i] for r in done], dtype=object if i < 3 else "int64") for c, i in (("path", 1), ("chars", 2), ("n", 3), ("low", 4))}).assign(ends=pd.Series([r[5].hexdigest() for r in done], dtype=object))

    plain = ordered.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    paths = plain.mapInPandas(chained, f"conv_id long, end binary, {_PATH}")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = paths.groupBy("end", F.floor(F.col("conv_id") / piece).alias("piece")).agg(
        F.first("path").alias("path"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids")
    )
    return pieces.repartition("end").sortWithinPartitions("end", "piece").mapInPandas(hashed, f"{_PATH}, n long, low long, ends string")


class Node:
    """A node of one slice; ``row`` is a conversation that passes through it."""

    __slots__ = ("row", "key", "depth", "n", "low", "ends", "children", "leaves", "saved", "parent", "kids")

    def __init__(self, row: int, key: bytes, depth: int) -> None:
        self.row, self.key, self.depth = row, key, depth
        self.n, self.low, self.ends, self.children, self.leaves, self.saved = 0, None, None, 0, 0, 0
        self.parent: Node | None = None
        self.kids: list[Node] = []

    def add(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)

    def values(self) -> tuple:
        return self.depth, self.low, self.n, self.children, self.leaves, self.saved, self.ends


def _key(path: bytes, depth: int) -> bytes:
    return path[WIDTH * (depth - 1) : WIDTH * depth] if depth else b""


def peel(paths: list[bytes], chars: list, counts: list[int], lows: list[int], ends: list[str]) -> tuple[list[Node], dict[bytes, Node]]:
    """All nodes of a slice, and those that are open: on its first or last path.

    A closed node's values are complete.  An open node's children are the closed ones, its leaves and savings those under these.
    """
    edge = {_key(p, d) for p in (paths[0], paths[-1]) for d in range(len(p) // WIDTH + 1)}
    stops = defaultdict(list)
    for r, p in enumerate(paths):
        stops[len(p) // WIDTH].append(r)
    nodes: list[Node] = []
    alive: dict[bytes, Node] = {}
    for depth in range(max(stops), -1, -1):
        for r in stops.get(depth, ()):
            key = _key(paths[r], depth)
            node = alive.get(key) or alive.setdefault(key, Node(r, key, depth))
            node.add(counts[r], lows[r])
            node.ends = ends[r]
        above: dict[bytes, Node] = {}
        for node in alive.values():
            nodes.append(node)
            closed = node.key not in edge
            if closed:
                node.leaves += not node.children
                node.saved += (node.n - 1) * int(chars[node.row][depth - 1])
            if depth:
                key = _key(paths[node.row], depth - 1)
                up = above.get(key) or above.setdefault(key, Node(node.row, key, depth - 1))
                up.add(node.n, node.low)
                node.parent = up
                if closed:
                    up.children += 1
                    up.leaves += node.leaves
                    up.saved += node.saved
                    up.kids.append(node)
        alive = above
    return nodes, {n.key: n for n in nodes if n.key in edge}


_VALUES = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_NAMES = ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
_SLICE = f"{_VALUES}, parent_conv_id long, open boolean, key binary, parent binary, route binary, chars long, kids array<struct<{_VALUES.replace(' ', ':').replace(',:', ', ')}>>"


def _slice_rows(batch: pd.DataFrame) -> Iterator[tuple]:
    paths, chars = batch["path"].tolist(), batch["chars"].tolist()
    nodes, edge = peel(paths, chars, batch["n"].tolist(), batch["low"].tolist(), batch["ends"].tolist())
    for node in nodes:
        if node.key not in edge and node.parent.key not in edge:
            yield (*node.values(), node.parent.low, False, None, None, None, None, None)
    told = set()
    for path in dict.fromkeys((paths[0], paths[-1])):
        for depth in range(len(path) // WIDTH + 1):
            node = edge[_key(path, depth)]
            place = (True, node.key, _key(path, depth - 1) if depth else None, path[-WIDTH:], int(chars[node.row][depth - 1]) if depth else 0)
            if node.key in told:
                yield (depth, None, 0, 0, 0, 0, None, None, *place, None)
            else:
                told.add(node.key)
                yield (*node.values(), None, *place, [dict(zip(_NAMES, k.values())) for k in node.kids])


def prefix_trie(ordered: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*_NAMES, "parent_conv_id", "open", "key", "parent", "route", "chars", "kids"]
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(list(_slice_rows(batch)), columns=names, dtype=object)

    rows = ended(ordered).repartitionByRange("path").sortWithinPartitions("path")
    parts = settled(rows.mapInPandas(sliced, _SLICE), "trie_slices")
    edge = parts.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_nodes = edge.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums,
        F.max("chars").alias("chars"), F.max("ends").alias("ends"), F.min("route").alias("owner"),
    )
    open_nodes = settled(open_nodes, "trie_edges")
    more = open_nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    full = open_nodes.join(more.hint("merge"), "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    full = full.withColumn("own_leaf", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("own_saved", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
    full = settled(full, "trie_open")
    # every open node is counted on the route that owns it, and from there for each node above it on that route
    along = Window.partitionBy("route").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    steps = edge.select("route", "key", "depth").distinct().join(full.select("key", "owner", "own_leaf", "own_saved").hint("merge"), "key")
    mine = lambda c: F.sum(F.when(F.col("owner") == F.col("route"), F.col(c)).otherwise(0)).over(along)
    owed = steps.select("key", mine("own_leaf").alias("leaf"), mine("own_saved").alias("saved")).groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = full.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).hint("merge")
    whole = full.drop("n_leaves", "saved_tokens").join(owed.hint("merge"), "key").join(parents, "parent", "left")
    kids = edge.where(F.size("kids") > 0).select(F.col("key").alias("parent"), "kids").join(parents, "parent").select("parent_conv_id", F.explode("kids").alias("k"))
    out = [*_NAMES, "parent_conv_id"]
    every = whole.select(*out).unionByName(parts.where(~F.col("open")).select(*out)).unionByName(kids.select("k.*", "parent_conv_id").select(*out))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    return prefix_trie(rebuilt(ordered_turns(conversations)))
