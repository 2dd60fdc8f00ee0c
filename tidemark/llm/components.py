"""Connected components of a table of links, by contraction.

Each round every class takes the smallest class it is linked to, chains are shortened by pointer
jumping, and links are rewritten between the new classes; links inside a class vanish.  At least
half of the linked classes disappear in a round.  Every round is a table in the shared folder, so
joins are plain shuffles of files that AQE can split where one class holds many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settled


def _jumped(parents: DataFrame) -> DataFrame:
    """Parents of parents until nothing changes; ``node, parent``."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        new = settled(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved")), "jumped")
        parents = new.select("node", "parent")
        if new.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of the links ``(a, b)``; the root is some node of the component."""
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settled(ends, "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        smallest = both.groupBy("node").agg(F.min("other").alias("other"))
        parents = _jumped(settled(smallest.select("node", F.least("node", "other").alias("parent")), "parents"))
        levels.append(parents)
        a = edges.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        a = settled(a.select("pa", "b"), "half")
        b = a.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").where("pa <> pb")
        edges = settled(b.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "links")
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = levels[0].select("node", F.col("parent").alias("root"))
    for parents in levels[1:]:
        up = parents.select(F.col("node").alias("root"), F.col("parent").alias("top"))
        out = settled(out.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    return out
