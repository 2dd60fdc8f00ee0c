"""Leak-safe series transforms.  Input and output are canonical observation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import calendar as cal
from tidemark.operators.ordered import fill_forward, interpolate, lags, running, trailing

KEY = ["series_id"]
CANONICAL = ["series_id", "timestamp", "value", "released_at"]


def finite(value: Column) -> Column:
    """A double with NaN and infinities turned into null, so comparisons behave."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def canonical(df: DataFrame) -> DataFrame:
    """Zone-less stamps, numeric-or-null values, incomplete rows dropped."""
    return df.select(
        "series_id",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        finite(F.col("value")).alias("value"),
        F.col("released_at").cast("timestamp_ntz").alias("released_at"),
    ).dropna()


def release_violations(df: DataFrame) -> DataFrame:
    """Rows released before their own stamp, for quarantine."""
    return df.filter(F.col("released_at") < F.col("timestamp"))


def drop_weekends(df: DataFrame) -> DataFrame:
    return df.filter(cal.is_weekday("timestamp"))


def positive(df: DataFrame) -> DataFrame:
    """Only positive values; applied before a lag so ratios span the dropped rows."""
    return df.filter(F.col("value") > 0)


def next_business_day_release(df: DataFrame) -> DataFrame:
    return df.withColumn("released_at", cal.add_business_days("timestamp", 1))


def released_at_close(df: DataFrame, hour: int = 16) -> DataFrame:
    """Release every row at a fixed hour of its own session."""
    return df.withColumn("released_at", cal.at_hour("timestamp", hour))


def released_after_days(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("released_at", cal.plus_days("timestamp", days))


def released_after_month_end(df: DataFrame, business_days: int = 10) -> DataFrame:
    return df.withColumn("released_at", cal.month_end_release("timestamp", business_days))


def log_returns(df: DataFrame) -> DataFrame:
    """Close-to-close log return, known from the next business day."""
    out = lags(positive(df), KEY, "timestamp", {"_prev": ("value", 1)})
    out = out.withColumn("value", F.ln(F.col("value") / F.col("_prev"))).drop("_prev").dropna(subset=["value"])
    return next_business_day_release(out).select(*CANONICAL)


def cumulative_log_returns(df: DataFrame, windows: Sequence[int]) -> DataFrame:
    """k-session log returns for several k at once, as series ``<id>_<k>b`` known at their own stamp."""
    out = lags(positive(df), KEY, "timestamp", {f"_p{k}": ("value", k) for k in windows})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_p{k}").alias("p")) for k in windows]))
    return (
        out.withColumn("_w", each)
        .select(
            F.concat_ws("_", "series_id", F.concat(F.col("_w.k").cast("string"), F.lit("b"))).alias("series_id"),
            "timestamp",
            F.ln(F.col("value") / F.col("_w.p")).alias("value"),
            F.col("timestamp").alias("released_at"),
        )
        .dropna(subset=["value"])
    )


def level(df: DataFrame) -> DataFrame:
    return canonical(next_business_day_release(df))


def feature_lag(df: DataFrame, rows: int = 1) -> DataFrame:
    """Shift values by rows; the shifted value is known at its new stamp."""
    out = lags(df, KEY, "timestamp", {"_prev": ("value", rows)})
    return (
        out.withColumn("value", F.col("_prev"))
        .withColumn("released_at", F.col("timestamp"))
        .dropna(subset=["value"])
        .select(*CANONICAL)
    )


def percent_change(df: DataFrame, rows: int, name: str = "return_pct") -> DataFrame:
    out = lags(df, KEY, "timestamp", {"_prev": ("value", rows)})
    return out.withColumn(name, (F.col("value") / F.col("_prev") - 1) * 100).drop("_prev")


def year_on_year(df: DataFrame) -> DataFrame:
    return percent_change(df, 12, "yoy_pct").dropna(subset=["yoy_pct"])


def shock_indicator(df: DataFrame, threshold_pct: float, horizon: int = 1) -> DataFrame:
    """0/1 series: did the ``horizon``-session percent move reach the threshold?  Releases are kept."""
    moved = percent_change(df, horizon).dropna(subset=["return_pct"])
    return moved.withColumn("value", (F.abs("return_pct") >= threshold_pct).cast("double")).select(*CANONICAL)


def rolling_std(df: DataFrame, column: str, rows: int, name: str, *, shift: int = 0) -> DataFrame:
    """Sample deviation of the last ``rows`` values, ``shift`` rows back; null until all of them exist."""

    def build(w):
        frame = w.rowsBetween(-(rows - 1) - shift, -shift)
        full = F.count(column).over(frame) == rows
        return {name: F.when(full, F.stddev_samp(column).over(frame))}

    return trailing(df, KEY, "timestamp", rows + shift, build)


def change_points(df: DataFrame) -> DataFrame:
    """Rows where a step series takes a new value, with the previous one."""
    out = lags(df, KEY, "timestamp", {"previous": ("value", 1)})
    return out.filter(F.col("previous").isNotNull() & (F.col("value") != F.col("previous")))


# --- calendars ---------------------------------------------------------------


def _spine(spans: DataFrame, frequency: str) -> DataFrame:
    """``series_id, timestamp`` for every grid date of each series' own ``[lo, hi]``."""
    return spans.select("series_id", F.explode(cal.calendar_grid("lo", "hi", frequency)).alias("timestamp"))


def on_calendar(df: DataFrame, frequency: str) -> DataFrame:
    """Reindex each series onto the full grid of its own span; missing dates get null values."""
    spans = df.groupBy("series_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return _spine(spans, frequency).join(df, ["series_id", "timestamp"], "left")


def business_daily_fill(df: DataFrame) -> DataFrame:
    """Complete business-day calendar with the last value carried over gaps; known at its own date."""
    filled = fill_forward(on_calendar(df.select("series_id", "timestamp", "value"), "B"), KEY, "timestamp")
    return filled.dropna(subset=["value"]).withColumn("released_at", F.col("timestamp")).select(*CANONICAL)


def fill_gaps(df: DataFrame, frequency: str) -> DataFrame:
    """Regular grid with interior gaps interpolated, as model fitting needs."""
    grid = on_calendar(df.select("series_id", "timestamp", "value"), frequency)
    return interpolate(grid, KEY, "timestamp").select("series_id", "timestamp", "value")


def expand_from_releases(df: DataFrame, start: str, end: str | None = None, *, carry_in: bool = False) -> DataFrame:
    """Daily business calendar on which each value appears on its release day and is carried.

    By default a release counts only on the exact business day it falls on: one dated
    on a weekend or before ``start`` never appears.  ``carry_in=True`` instead rolls
    releases forward to the next business day (and to ``start``).
    """
    spans = df.groupBy("series_id").agg(F.max("released_at").alias("_last")).select(
        "series_id",
        F.lit(start).cast("timestamp_ntz").alias("lo"),
        (F.lit(end).cast("timestamp_ntz") if end else cal.add_business_days("_last", 1)).alias("hi"),
    )
    stamped = df.select("series_id", F.col("released_at").alias("timestamp"), "value", F.col("timestamp").alias("_ref"))
    if carry_in:
        first = F.greatest(F.col("timestamp"), F.lit(start).cast("timestamp_ntz"))
        stamped = stamped.withColumn("timestamp", cal.add_business_days(first, 0))
    newest = stamped.groupBy("series_id", "timestamp").agg(F.max_by("value", "_ref").alias("value"))
    grid = _spine(spans, "B").join(newest, ["series_id", "timestamp"], "left")
    filled = fill_forward(grid, KEY, "timestamp").dropna(subset=["value"])
    return filled.withColumn("released_at", F.col("timestamp")).select(*CANONICAL)


# --- several series at once ----------------------------------------------------


def log_ratio(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ln(numerator / denominator)`` on dates both series have, for every pair in ``pairs``.

    ``pairs``: ``series_id, numerator, denominator`` (the new id and its two inputs).
    The ratio is filled over the business calendar and lagged one row.
    """
    num = df.select(F.col("series_id").alias("numerator"), "timestamp", F.col("value").alias("_n"))
    den = df.select(F.col("series_id").alias("denominator"), "timestamp", F.col("value").alias("_d"))
    both = pairs.join(num, "numerator").join(den, ["denominator", "timestamp"]).filter((F.col("_n") > 0) & (F.col("_d") > 0))
    ratio = both.select("series_id", "timestamp", F.ln(F.col("_n") / F.col("_d")).alias("value"))
    return feature_lag(business_daily_fill(ratio))


def spread(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Difference of two series on shared dates."""
    num = df.select(F.col("series_id").alias("numerator"), "timestamp", F.col("value").alias("_n"))
    den = df.select(F.col("series_id").alias("denominator"), "timestamp", F.col("value").alias("_d"))
    both = pairs.join(num, "numerator").join(den, ["denominator", "timestamp"])
    return both.select("series_id", "timestamp", (F.col("_n") - F.col("_d")).alias("value"))


def covariate_panel(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """Wide panel of the named series over the span all of them cover.

    The span test runs on one row per series; the pivot has a fixed column list.
    """
    chosen = df.filter(F.col("series_id").isin(*series))
    spans = chosen.groupBy("series_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    common = spans.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    wide = chosen.groupBy("timestamp").pivot("series_id", list(series)).agg(F.first("value"))
    # `common` is a single row by construction.
    return wide.join(F.broadcast(common), F.col("timestamp").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def first_available(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each target id, the highest-priority source that has any rows.

    ``candidates``: ``series_id, source_id, priority``.
    """
    present = df.select(F.col("series_id").alias("source_id")).distinct()
    best = candidates.join(present, "source_id").groupBy("series_id").agg(F.min_by("source_id", "priority").alias("source_id"))
    rows = df.withColumnRenamed("series_id", "source_id")
    return best.join(rows, "source_id").select(*CANONICAL)


# Recipes for building many covariates from one observations table.  Each step takes
# and returns canonical rows of *all* series of that recipe at once.
RECIPES = {
    "daily_level": (drop_weekends, business_daily_fill, feature_lag),
    "daily_return": (drop_weekends, positive, business_daily_fill, log_returns, feature_lag),
    "close_return": (log_returns, business_daily_fill, feature_lag),
    "market_level": (level, business_daily_fill, feature_lag),
}


def build_covariates(df: DataFrame, registry: DataFrame, *, strict: bool = False) -> DataFrame:
    """Build every registered covariate: ``registry(series_id, source_id, recipe)``.

    Sources are renamed to their covariate id and each recipe runs once over all its
    series.  With ``strict`` a registered covariate without rows is an error;
    otherwise it is skipped.
    """
    source = df.withColumnRenamed("series_id", "source_id")
    # The registry is configuration; at most one row per known recipe comes back.
    used = {r.recipe for r in registry.select("recipe").distinct().collect()}
    unknown = used - set(RECIPES)
    if unknown:
        raise ValueError(f"unknown recipes: {sorted(unknown)}")
    built = None
    for name, steps in RECIPES.items():
        if name not in used:
            continue
        mine = registry.filter(F.col("recipe") == name)
        part = mine.join(source, "source_id").select(*CANONICAL)
        for step in steps:
            part = step(part)
        built = part if built is None else built.unionByName(part)
    if strict:
        lost = registry.join(built.select("series_id").distinct(), "series_id", "left_anti")
        names = [r.series_id for r in lost.select("series_id").limit(20).collect()]
        if names:
            raise ValueError(f"covariates without rows: {names}")
    return built


def running_mean(df: DataFrame, keys: Sequence[str], time: str, column: str, name: str) -> DataFrame:
    """Mean of all non-null values so far."""
    seen = F.when(F.col(column).isNotNull(), F.lit(1))
    out = running(df, keys, time, {"_s": ("sum", F.col(column)), "_n": ("sum", seen)})
    return out.withColumn(name, F.col("_s") / F.col("_n")).drop("_s", "_n")
