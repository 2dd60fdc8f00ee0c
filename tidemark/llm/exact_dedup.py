"""Exact deduplication against a persistent digest index; DataFrame operations only.

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per digest on
the map side first, a sort-merge anti-join keeps the digests the index has not seen, and those are
appended.  The index side of that join is read in its buckets and never shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, same_row
from tidemark.session import settled, shared_folder

#: Characters that do not count: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"

SCHEMA = "digest binary, keep_id {kind}, keep_row long, group_size long, batch string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_hash, digest, n_points``: SHA-256 of the text without blanks, and the code points of the whole text."""
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    plain = F.translate("text", BLANKS, "")
    return rows.select("doc_id", "row_hash", F.unhex(F.sha2(plain, 256)).alias("digest"), F.char_length("text").alias("n_points"))


@dataclass
class DigestIndex:
    """A digest table at ``path`` under the session's catalogue name ``table``; made at the first batch.

    ``buckets`` is fixed when the table is made: choose it so that a bucket of the final index is
    of the size of a task.  A new session opens an existing index by giving the same path.
    """

    spark: SparkSession
    path: str = ""
    buckets: int = 64
    kind: str = "bigint"
    table: str = field(default_factory=lambda: f"digests_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self.path = self.path or f"{shared_folder(self.spark)}/{self.table}"
        if not self.spark.catalog.tableExists(self.table):
            columns = SCHEMA.format(kind=self.kind)
            self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Add a batch; one row per row of it: ``doc_id, keep_id, group_size, kept, text_sha256``.

        Of equal texts the row already in the index stays, else the one with the most code points,
        then the smallest id (null last), then the smallest row hash.  ``group_size`` counts the
        batch's rows.  Nulls and empty or blank texts are equal to each other.  Rows repeated in
        full (same id and text) are counted each and share one answer.

        ``batch`` names the batch: an append that failed at any point, or that is run again later, gives the same answer under
        the same name, for the digests it has already added count as its own.  Without a name every call is a batch of its own.
        Batches are appended one at a time.
        """
        batch = batch or uuid.uuid4().hex
        rows = settled(digests(docs, id_col, text_col), "digests")
        best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "row_hash"))
        groups = settled(rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
        fresh = groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_hash").alias("keep_row"), "group_size", F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        known = self.read().select("digest", "keep_id", "keep_row", (F.col("batch") == batch).alias("new"))
        # both sides of the last join are plain shuffles of files, so a digest that holds a third of the rows is split at run time
        verdicts = settled(groups.select("digest", "group_size").hint("merge").join(known, "digest"), "verdicts")
        mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_row"))
        return rows.join(verdicts, "digest").select("doc_id", "keep_id", "group_size", (F.col("new") & mine).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_hash")


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch's rows that stay, with all their columns."""
    stay = index.append(docs, id_col, text_col).where("kept").select("doc_id", "row_hash").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"))
    return own.join(stay, same_row(own, stay), "left_semi").select("row.*")
