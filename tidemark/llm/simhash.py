"""SimHash near-duplicates, searched in BK-trees.

Fingerprints that differ in at most ``radius`` (3) of 64 bits agree in at least one of four 16-bit
blocks, so each distinct fingerprint is placed in four shards, one per block, and searched only in
the tree of its own block value.  A shard gathers neighbouring block values up to a few thousand
fingerprints and is built in one task as a forest of BK-trees, one per block value.  A shard that one
value overfills is cut by hash into pieces of bounded size; then every piece's tree is sent, by a
join on the shard, to the fingerprints of all its pieces.  Trees thus travel only to the tasks that
search them: broadcasting all trees to every executor would need all fingerprints on the driver.

Copies never meet: only distinct fingerprints are searched, and from each tree only a spanning
forest of the links found leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bk_tree import Forest, Union
from tidemark.llm.common import keyed
from tidemark.llm.components import components
from tidemark.session import settled

BLOCKS, BITS = 4, 16
_SEED = 42


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of every shingle of the text lower-cased in A-Z, repeats included; of the whole sequence where it is shorter."""
    words = text.encode().lower().split()  # bytes: only A-Z and U+0009 to U+000D and the space
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), _SEED)]
    return [xxhash.xxh64_intdigest(s, _SEED) for s in map(b" ".join, zip(*[words[i:] for i in range(width)]))]


def simhash(hashes: list[int]) -> int:
    """Bit i is 1 where more than half of the hashes have it."""
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for start in range(0, len(every), 16_384):
        part = every[start : start + 16_384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, fp`` (the fingerprint as a signed long) for every row; without words it is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([simhash(shingle_hashes(t, width)) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row_hash": batch["row_hash"], "fp": fp})

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col=id_col, text_col=text_col).mapInPandas(run, f"doc_id {kind}, row_hash long, fp long")


def links(distinct: DataFrame, radius: int = 3, shard_size: int = 16_384, piece_size: int = 32_768) -> DataFrame:
    """``a, b``: a spanning forest, per tree searched, of all pairs of fingerprints ``fp`` within the radius."""
    if not 0 <= radius < BLOCKS:
        raise ValueError("the radius must be below the number of blocks")
    shards_per_block = 1
    n = distinct.count()
    while shards_per_block < 1 << BITS and n / shards_per_block > shard_size:
        shards_per_block *= 2
    low_bits = BITS - shards_per_block.bit_length() + 1
    block = F.col("block")
    value = F.expr(f"shiftrightunsigned(fp, block * {BITS})").bitwiseAND((1 << BITS) - 1)
    placed = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(BLOCKS)])).alias("block"))
    placed = placed.select("fp", (block * (1 << BITS) + F.shiftright(value, low_bits)).cast("int").alias("shard"))
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(piece_size)).cast("int").alias("pieces"))
    sizes = settled(sizes, "shards")
    cut = settled(placed, "placed").join(sizes, "shard").select("fp", "shard", "pieces", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int").alias("piece"))
    # a piece has piece_size fingerprints on average, at 8 bytes each
    trees = settled(cut.groupBy("shard", "piece", "pieces").agg(F.collect_list("fp").alias("fps")), "trees")
    alone = trees.where("pieces = 1").select("shard", "fps", F.lit(None).cast("array<long>").alias("others"))
    split = trees.where("pieces > 1")
    other = split.select("shard", F.col("piece").alias("other"), F.col("fps").alias("others"))
    pairs = split.join(other, "shard").where("other >= piece").select("shard", "fps", F.when(F.col("other") != F.col("piece"), F.col("others")).alias("others"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, fps, others in batch.itertuples(index=False):
                points = np.asarray(fps, dtype=np.int64).view(np.uint64)
                probes = points if others is None else np.asarray(others, dtype=np.int64).view(np.uint64)
                shift = np.uint64(int(shard) >> BITS) * np.uint64(BITS)
                where = lambda x: ((x >> shift) & np.uint64((1 << low_bits) - 1)).astype(np.int64)  # noqa: B023, E731
                forest = Forest(points, where(points))
                base = 0 if others is None else len(points)
                union = Union(base + len(probes))
                for q, p in forest.within(probes, where(probes), radius):
                    union.link(q + base, p)
                every = points if others is None else np.r_[points, probes]
                root = union.roots()
                linked = root != np.arange(len(root))
                yield pd.DataFrame({"a": every[linked].view(np.int64), "b": every[root[linked]].view(np.int64)})

    return alone.unionAll(pairs).repartition("shard", F.xxhash64("fps"), F.xxhash64("others")).mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, fp, component_id, first_row`` for every row.

    Rows whose fingerprints are linked through any chain share a component; its id is the smallest
    ``doc_id`` in it (null only where all are), ``first_row`` whether the row is the one that stays:
    the smallest id, then the smallest row hash.  Null, empty and blank texts have fingerprint 0.
    """
    marks = settled(fingerprints(docs, width, id_col, text_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash")
    distinct = settled(marks.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = settled(rooted, "rooted")
    firsts = settled(rooted.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    classes = settled(rooted.select("fp", "root").join(firsts.hint("merge"), "root").select("fp", "first"), "classes")
    return marks.join(classes.hint("merge"), "fp").select("doc_id", "row_hash", "fp", F.col("first.doc_id").alias("component_id"), (order == F.col("first")).alias("first_row"))
