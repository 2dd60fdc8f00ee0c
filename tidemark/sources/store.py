"""The observation store: one partitioned table, plus metadata and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import OBSERVATIONS, SERIES_META, conform

BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("series_id"), F.lit(BUCKETS)).cast("int")


def register(observations: DataFrame, meta: DataFrame, path: str) -> None:
    """Add series: their rows replace any stored rows of the same series, their metadata likewise.

    Series are spread over a fixed number of hash folders (a folder per series would be
    millions of small files) and sorted inside them, so one series reads a few row groups.
    """
    spark = observations.sparkSession
    rows = conform(observations, OBSERVATIONS).withColumn("bucket", _bucket())
    _replace(spark, rows, f"{path}/observations")
    _replace(spark, conform(meta, SERIES_META).withColumn("bucket", _bucket()), f"{path}/series_meta")


def _replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    from tidemark.plans.backtest import _exists

    if _exists(spark, path):
        touched = rows.select("bucket").distinct()
        old = spark.read.parquet(path).join(touched, "bucket", "left_semi")
        kept = old.join(rows.select("series_id").distinct(), "series_id", "left_anti").select(*rows.columns)
        # The merged buckets are staged first: a folder cannot be read and overwritten in one job.
        staged = f"{path}_staged"
        kept.unionByName(rows).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
    order = [c for c in ("series_id", "timestamp") if c in rows.columns]
    (
        rows.repartition("bucket", "series_id")
        .sortWithinPartitions("bucket", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def series(spark: SparkSession, path: str, *series_ids: str) -> DataFrame:
    """Stored rows, of the named series only when given (folders and row groups are pruned)."""
    df = spark.read.parquet(f"{path}/observations")
    if series_ids:
        buckets = [r[0] for r in spark.createDataFrame([(s,) for s in series_ids], "series_id string").select(_bucket()).collect()]
        df = df.filter(F.col("bucket").isin(*buckets) & F.col("series_id").isin(*series_ids))
    return df.drop("bucket")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/series_meta").drop("bucket")


def series_ids(observations: DataFrame) -> DataFrame:
    return observations.select("series_id").distinct().orderBy("series_id")


def summary(observations: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows, first and last stamp per series, beside its metadata."""
    stats = observations.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    return meta.join(stats, "series_id", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long")))


# --- ledgers and trails ----------------------------------------------------------------


def spend(usage: DataFrame, prices: DataFrame, search_fee: float) -> DataFrame:
    """Cost per usage row; an unknown model is charged at the dearest rate.

    ``prices`` is a rate card of a few models, so its maximum is one row.
    """
    dearest = prices.agg(F.max(F.struct("price_in", "price_out")).alias("_top"))
    rated = usage.join(prices, "model", "left").join(F.broadcast(dearest))
    cost = (
        F.col("tokens_in") * F.coalesce("price_in", F.col("_top.price_in"))
        + F.col("tokens_out") * F.coalesce("price_out", F.col("_top.price_out"))
        + F.col("searches") * F.lit(search_fee)
    )
    return rated.withColumn("usd", cost).withColumn("priced", F.col("price_in").isNotNull()).drop("_top", "price_in", "price_out")


def budget(ledger: DataFrame, cap_usd: float, *keys: str) -> DataFrame:
    spent = ledger.groupBy(*keys).agg(F.sum("usd").alias("spent_usd"), F.count(F.lit(1)).alias("n_entries"))
    return spent.withColumn("remaining_usd", F.lit(cap_usd) - F.col("spent_usd"))


def upsert_latest(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace stored rows that share a key with ``new`` (merge by overwrite)."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def trail(entries: DataFrame, key: str = "pattern_id", when: str = "evaluated_on") -> DataFrame:
    """Append-only trail with the newest entry of each key marked current and its history length.

    Two aggregates instead of a window, so a key evaluated very often stays spread out.
    """
    newest = entries.groupBy(key).agg(F.max(when).alias(when), (F.count(F.lit(1)) - 1).alias("n_history"))
    return entries.join(newest.withColumn("is_current", F.lit(True)), [key, when], "left").withColumn(
        "is_current", F.coalesce("is_current", F.lit(False))
    )


def current(entries: DataFrame, key: str = "pattern_id", when: str = "evaluated_on") -> DataFrame:
    return trail(entries, key, when).filter("is_current")


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order they first appear."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("first_position")).orderBy("first_position")


