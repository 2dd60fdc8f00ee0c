"""Landed files to canonical observations.  A source is a function ``(...) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import calendar as cal
from tidemark.operators.features import CANONICAL, canonical, finite


def table_id(raw: Column) -> Column:
    """The first eight digits of a statistical table id (a view suffix is dropped)."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.substring(digits, 1, 8)


def safe_key(raw: Column) -> Column:
    """A file-system-safe lower-case form of an identifier."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def wide_table(spark: SparkSession, path: str, columns: Sequence[str], value: str = "VALUE", date: str = "REF_DATE") -> DataFrame:
    """A statistical CSV: all columns text, then the value as a number and the date as a stamp.

    Bad dates and numbers become null instead of failing the read.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    return wide_from_text(raw, value, date)


def wide_from_text(raw: DataFrame, value: str = "VALUE", date: str = "REF_DATE") -> DataFrame:
    text = F.col(f"`{date}`").cast("string")
    day = F.coalesce(text.try_cast("timestamp_ntz"), F.concat(text, F.lit("-01")).try_cast("timestamp_ntz"))
    return raw.withColumn(date, day).withColumn(value, finite(F.col(f"`{value}`")))


def select_members(
    table: DataFrame, members: DataFrame, dimensions: Sequence[str], release_lag_days: int = 21,
    value: str = "VALUE", date: str = "REF_DATE",
) -> DataFrame:
    """All wanted series from one scan: an equi-join of the table with a mapping of members to series ids.

    ``members`` has ``series_id`` and a value for every column in ``dimensions``.  Rows are
    released a fixed number of days after their date.
    """
    hit = table.join(members.select("series_id", *[f"`{d}`" for d in dimensions]), list(dimensions))
    rows = hit.select("series_id", F.col(f"`{date}`").alias("timestamp"), F.col(f"`{value}`").alias("value"))
    return canonical(rows.withColumn("released_at", cal.plus_days("timestamp", release_lag_days)))


def same_day_release(df: DataFrame) -> DataFrame:
    """Macro series as delivered: visible on their own stamp (callers restamp or drop the newest row)."""
    return canonical(df.withColumn("released_at", F.col("timestamp")))


def ohlcv(df: DataFrame, fields: Sequence[str], ticker: str = "ticker", date: str = "date") -> DataFrame:
    """Daily bars to one series per ticker and field, known on the next business day."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
    long = df.select(F.col(ticker).alias("_t"), F.col(date).cast("timestamp_ntz").alias("timestamp"), pairs.alias("_p"))
    rows = long.select(
        F.concat_ws("_", safe_key(F.lower("_t")), "_p.field").alias("series_id"),
        cal.midnight("timestamp").alias("timestamp"),
        F.col("_p.value").alias("value"),
    )
    return canonical(rows.withColumn("released_at", cal.add_business_days("timestamp", 1)))


def bars_with_open(df: DataFrame, ticker: str = "ticker", date: str = "date") -> DataFrame:
    """Close series carrying the session's open beside it."""
    return df.select(
        safe_key(F.lower(F.col(ticker))).alias("series_id"),
        cal.midnight(F.col(date).cast("timestamp_ntz")).alias("timestamp"),
        finite(F.col("close")).alias("value"),
        finite(F.col("open")).alias("open"),
        cal.add_business_days(cal.midnight(F.col(date).cast("timestamp_ntz")), 1).alias("released_at"),
    ).dropna(subset=["timestamp", "value"])


def date_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Half-open ``[start, end)`` on the stamp."""
    out = df if start is None else df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.filter(F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def covers_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Per series: does the stored span open by the first business day of the range and reach its last day?

    ``end`` is exclusive, so the last day wanted is the one before it.
    """
    first = cal.add_business_days(F.lit(start).cast("timestamp_ntz"), 0)
    last = cal.plus_days(F.lit(end).cast("timestamp_ntz"), -1)
    spans = df.groupBy("series_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return spans.withColumn("covered", (F.col("first") <= first) & (F.col("last") >= last))


def as_price_frame(df: DataFrame) -> DataFrame:
    """``series_id, date, price`` view of observations."""
    return df.select("series_id", F.to_date("timestamp").alias("date"), F.col("value").alias("price"))


def from_frame(df: DataFrame, series_id: str | None = None) -> DataFrame:
    """Any DataFrame with the canonical columns as a source (released on its own stamp when unstated)."""
    out = df if series_id is None else df.withColumn("series_id", F.lit(series_id))
    if "released_at" not in out.columns:
        out = out.withColumn("released_at", F.col("timestamp"))
    return canonical(out.select(*CANONICAL))
