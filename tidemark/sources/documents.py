"""Dated documents: scans, sinks and what was published by when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import text as tx
from tidemark.operators import asof
from tidemark.schemas import DOCUMENTS, conform

_RAW = (
    "meta struct<doc_id:string,publication_date:string,title:string,lang:string>, text string, text_path string, "
    "page_count int, est_tokens long, extracted_at string, _corrupt_record string"
)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def scan(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Read a folder of ``<id>.json`` artefacts and their ``<id>.md`` companions."""

    def files(pattern: str, name: str) -> DataFrame:
        read = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
        return read.select(_stem(F.input_file_name()).alias("stem"), F.col("value").alias(name))

    return parse_artefacts(files("*.json", "json"), files("*.md", "text"), source)


def parse_artefacts(artefacts: DataFrame, companions: DataFrame, source: str) -> DataFrame:
    """``stem, json`` rows to documents; unreadable JSON is skipped, empty texts come from ``companions`` (``stem, text``).

    The companion shares the artefact's stem, else it is the recorded ``text_path``'s file name.
    """
    a = F.from_json("json", _RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = artefacts.select("stem", a.alias("a")).select("stem", "a.*")
    good = raw.filter(F.col("_corrupt_record").isNull() & F.col("meta.publication_date").isNotNull())
    empty = F.nullif(F.col("text"), F.lit("")).isNull()
    # Only artefacts without a text look for one, so inline texts are not shuffled against the companions.
    wanting = good.filter(empty).withColumn("_ref", _stem(F.col("text_path")))
    side = companions.select("stem", F.col("text").alias("_md"))
    recorded = companions.select(F.col("stem").alias("_ref"), F.col("text").alias("_md_ref"))
    found = wanting.join(side, "stem", "left").join(recorded, "_ref", "left").withColumn("text", F.coalesce("_md", "_md_ref", F.lit("")))
    joined = good.filter(~empty).unionByName(found.select(*good.columns))
    return conform(
        joined.select(
            F.lit(source).alias("source"),
            F.coalesce("meta.doc_id", "stem").alias("doc_id"),
            F.to_date("meta.publication_date").alias("publication_date"),
            F.col("meta.title").alias("title"),
            F.coalesce("meta.lang", F.lit("en")).alias("lang"),
            "text",
            F.coalesce("page_count", F.lit(0)).alias("page_count"),
            F.length("text").cast("long").alias("n_chars"),
            F.coalesce("est_tokens", F.lit(0).cast("long")).alias("est_tokens"),
            F.col("extracted_at").try_cast("timestamp_ntz").alias("extracted_at"),
        ),
        DOCUMENTS,
    )


def write(documents: DataFrame, path: str) -> None:
    """Store documents with a content hash, clustered by source and publication month."""
    (
        provenance(documents)
        .withColumn("published_month", F.trunc("publication_date", "MM"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "published_month").parquet(path)
    )


def provenance(documents: DataFrame) -> DataFrame:
    return documents.withColumn("sha256", F.sha2("text", 256)).withColumn("content_length", F.octet_length("text").cast("long"))


def visible(documents: DataFrame, origins: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Documents published on or before a date, or the count and newest one at every origin.

    With a table of origins the answer is an as-of state (``n_documents, newest``), not a
    pairing of origins with documents.
    """
    if as_of is not None:
        return documents.filter(F.col("publication_date") <= F.lit(as_of).cast("date"))
    published = F.col("publication_date").cast("timestamp_ntz")
    newest = ("max", F.struct(published.alias("at"), "doc_id", "title"))
    out = asof.state_at(origins, documents, ["source"], "as_of", published, {"n_documents": asof.count_rows(), "newest": newest}, many_per_time=True)
    return out.withColumn("n_documents", F.coalesce("n_documents", F.lit(0).cast("long")))


def for_date(documents: DataFrame, events: DataFrame) -> DataFrame:
    """The document published on each event's date."""
    return events.join(documents.withColumnRenamed("publication_date", "event_date"), ["source", "event_date"])


def first_and_last(documents: DataFrame) -> DataFrame:
    key = F.struct("publication_date", "doc_id")
    return documents.groupBy("source").agg(F.min_by("doc_id", key).alias("first_doc"), F.max_by("doc_id", key).alias("last_doc"), F.count(F.lit(1)).alias("n_documents"))


def from_pages(pages: DataFrame, source: str, min_chars: int = 400, sentinel: str | None = None) -> DataFrame:
    """Extract readable text from HTML pages; rows too short or without the sentinel phrase are flagged."""
    out = pages.withColumn("text", tx.extract_main_text("html")).withColumn("n_chars", F.length("text").cast("long"))
    ok = F.col("n_chars") >= min_chars
    if sentinel:
        ok = ok & F.lower("text").contains(sentinel.lower())
    return out.withColumn("source", F.lit(source)).withColumn("est_tokens", tx.estimated_tokens(F.col("n_chars"))).withColumn("usable", ok)


def enough_text(documents: DataFrame, min_chars_per_page: int) -> DataFrame:
    """Documents whose text is long enough for their page count (else probably scanned images)."""
    return documents.filter(F.col("n_chars") >= F.lit(min_chars_per_page) * F.greatest(F.col("page_count"), F.lit(1)))


def entries_from_calendar(calendar: DataFrame, source: str, url_prefix: str) -> DataFrame:
    """Document id, address and date for every scheduled event."""
    iso = F.date_format("event_date", "yyyy-MM-dd")
    return calendar.select(
        F.lit(source).alias("source"), F.concat(iso, F.lit("_en")).alias("doc_id"),
        F.concat(F.lit(url_prefix), F.date_format("event_date", "/yyyy/MM/"), iso, F.lit("/")).alias("url"), "event_date",
    )


def dated_files(spark: SparkSession, folder: str, dates: DataFrame) -> DataFrame:
    """Context files named ``..._<YYYY-MM-DD>.md`` for the requested dates; a missing date keeps a null content.

    With several files for a date the first name wins.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(
        F.input_file_name().alias("_path"), F.col("value").alias("content")
    )
    dated = files.withColumn("date", F.to_date(F.regexp_extract("_path", r"(\d{4}-\d{2}-\d{2})\.md$", 1)))
    first = dated.filter(F.col("date").isNotNull()).groupBy("date").agg(F.min_by("content", "_path").alias("content"))
    return dates.join(first, "date", "left")
