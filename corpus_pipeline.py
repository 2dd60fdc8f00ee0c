"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet and read back as the next one's documents.  All but the last
return the columns of ``documents``; rows keep their ids.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, quality_rules, set_join, suffix_dedup
from tidemark.llm.common import blank, same_row, text_of
from tidemark.session import shared_folder, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return call


def _whole(docs: DataFrame) -> DataFrame:
    """``row``: all columns; ``doc_id`` and ``row_hash``: the row's identity for the operators."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(text_of()).alias("row_hash"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    rows, keys = _whole(docs), keys.select("doc_id", "row_hash").distinct()
    return rows.join(keys.hint("merge"), same_row(rows, keys), "left_semi").select("row.*")


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with a new ``text`` where one is given, and ``n_chars`` counted anew there; rows whose new text has no word are left out."""
    rows = _whole(docs)
    both = rows.join(texts.hint("merge"), same_row(rows, texts), "left")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    both = both.where(~F.coalesce(blank("new_text"), F.lit(False)))
    text = F.coalesce("new_text", F.col("row.text"))
    out = both.select(*own, text.alias("text"), *([F.when(F.col("new_text").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text).cast("long")).alias("n_chars")] if "n_chars" in docs.columns else []))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@_shipped
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return _only(docs, quality_rules.quality_rules(docs).where("kept"))


@_shipped
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of three-line windows seen before; one that has nothing else goes."""
    found = line_dedup.line_dedup(docs).where("n_removed > 0").select("doc_id", "row_hash", F.col("kept_text").alias("new_text"))
    return _with_text(docs, found.dropDuplicates(["doc_id", "row_hash"]))


@_shipped
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return _only(docs, set_join.near_duplicates(docs, width=5, percent=80).where("first_row"))


@_shipped
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of passages of 200 bytes; one that has nothing else goes."""
    return suffix_dedup.stripped(docs, "doc_id", "text")


@_shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, every window in the corpus's mixture of sources; one row per piece."""
    return packing.pack(docs).drop("row_hash")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("packing", packed),
]

#: Shingle sets, suffix arrays and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
