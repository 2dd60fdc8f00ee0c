"""Set-oriented forecasters: every series x origin x horizon in one plan.

A forecaster takes the *context* (one row per origin, from :func:`context`) and the
observations, and returns prediction rows.  Fits that the usual harness repeats at every
origin are prefix statistics here: moments, normal equations and filter states are
accumulated once along each series and read off at the origins.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import calendar as cal, scoring as sc
from tidemark.functions.text import first_json_object
from tidemark.operators import asof, boosting, filters, quantreg
from tidemark.operators.features import fill_gaps
from tidemark.operators.logistic import fit_at_origins  # noqa: F401 - part of this module's interface
from tidemark.operators.ordered import exact_percentiles, lags, row_index, trailing as trailing_rows
from tidemark.session import settled

KEY = ["series_id"]
PREDICTION_COLUMNS = [
    "spec_id", "predictor_id", "task_id", "series_id", "as_of", "horizon", "forecast_date",
    "payload_type", "point", "quantiles", "probability", "probs", "metadata",
]


def _seen(origins: DataFrame, observations: DataFrame) -> DataFrame:
    rows = lags(row_index(observations, KEY, "timestamp", "_i"), KEY, "timestamp", {"_prev": ("value", 1)})
    r = F.when((F.col("value") > 0) & (F.col("_prev") > 0), F.ln(F.col("value") / F.col("_prev")))
    state = asof.visible_state(
        origins,
        rows.withColumn("_r", r),
        {
            "first": asof.earliest("value"),
            "r_sum": ("sum", F.col("_r")),
            "r_squares": ("sum", F.col("_r") * F.col("_r")),
            "_top": ("max", F.col("_i")),
        },
    )
    return state.withColumn("in_order", F.coalesce(F.col("_top") == F.col("n_visible"), F.lit(True))).drop("_top")


def context(origins: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per origin with what its target showed at that moment, written once for all forecasters.

    Adds ``n_visible``, ``first`` and ``last`` (STRUCT<at, value>), the sums of log returns
    and their squares over visible rows, and ``in_order``: whether the visible rows are the
    earliest ones of the series.  At other origins a row is visible while an earlier stamp
    is unreleased, so their returns are taken over the visible rows alone.
    """
    ctx = settled(_seen(origins, observations), "context")
    late = ctx.filter(~F.col("in_order"))
    if late.isEmpty():
        return ctx
    own = _seen(*asof.vintages(late.select(*origins.columns), observations))
    own = own.withColumn("series_id", asof.root(F.col("series_id"))).withColumn("in_order", F.lit(False))
    return settled(ctx.filter("in_order").unionByName(own), "context")


def cut_first(forecaster: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a forecaster that lags or fills rows work, at each origin, on rows released by then.

    Where the visible rows are the earliest of their series, cutting before or after gives
    the same and one pass serves all origins.  The other origins get a copy of what they saw.
    """

    @functools.wraps(forecaster)
    def call(ctx: DataFrame, observations: DataFrame, *args, **kwargs) -> DataFrame:
        late = ctx.filter(~F.col("in_order"))
        if late.isEmpty():
            return forecaster(ctx, observations, *args, **kwargs)
        probes, rows = asof.vintages(late, observations)
        own = forecaster(probes, settled(rows, "vintages"), *args, **kwargs)
        own = own.withColumn("series_id", asof.root(F.col("series_id")))
        return forecaster(ctx.filter("in_order"), observations, *args, **kwargs).unionByName(own)

    return call


@cut_first
def visible_range(ctx: DataFrame, observations: DataFrame, n: int) -> DataFrame:
    """Greatest and least of the ``n`` newest visible values at each origin, as ``high`` and ``low``."""
    ranged = trailing_rows(
        observations, KEY, "timestamp", n - 1,
        lambda w: {"hi": F.max("value").over(w.rowsBetween(1 - n, 0)), "lo": F.min("value").over(w.rowsBetween(1 - n, 0))},
    )
    out = asof.state_at(ctx, ranged, KEY, "as_of", asof.released(), {"_range": asof.latest("hi", "lo")})
    return out.withColumns({"high": F.col("_range.hi"), "low": F.col("_range.lo")}).drop("_range")


def horizons_of(ctx: DataFrame) -> DataFrame:
    """One row per origin and horizon, with its forecast date."""
    each = ctx.withColumn("horizon", F.explode("horizons"))
    return each.withColumn("forecast_date", cal.add_periods("as_of", F.col("frequency"), F.col("horizon")))


def _predictions(
    df: DataFrame, predictor_id: str, *, point: Column | None = None, quantiles: Column | None = None,
    probability: Column | None = None, probs: Column | None = None, metadata: Column | None = None,
) -> DataFrame:
    null = F.lit(None)
    return df.select(
        "spec_id", F.lit(predictor_id).alias("predictor_id"), "task_id", "series_id", "as_of",
        F.col("horizon").cast("int").alias("horizon"), "forecast_date", "payload_type",
        (point if point is not None else null).cast("double").alias("point"),
        (quantiles if quantiles is not None else null).cast("array<struct<q:double,v:double>>").alias("quantiles"),
        (probability if probability is not None else null).cast("double").alias("probability"),
        (probs if probs is not None else null).cast("map<string,double>").alias("probs"),
        (metadata if metadata is not None else null).cast("string").alias("metadata"),
    )


def last_value(ctx: DataFrame, observations: DataFrame) -> DataFrame:
    """Naive: the last visible value at every level."""
    df = horizons_of(ctx.filter(F.col("last").isNotNull()))
    v = F.col("last.value")
    return _predictions(df, "last_value_naive", point=v, quantiles=sc.point_mass(v))


def grid_steps(first: Column, last: Column, frequency: Column) -> Column:
    """Number of calendar steps between two stamps on a frequency's grid."""
    days = F.datediff(F.to_date(last), F.to_date(first))
    return (
        F.when(frequency == "B", cal.business_days_between(first, last))
        .when(frequency == "MS", cal.months_between_labels(first, last))
        .when(frequency == "W", F.floor(days / 7))
        .when(frequency == "h", F.timestamp_diff("HOUR", first, last))
        .otherwise(days)
        .cast("double")
    )


def log_random_walk(ctx: DataFrame, observations: DataFrame) -> DataFrame:
    """Random walk with drift on log values, in closed form.

    Gaps filled by carrying the last value add zero returns, so the filled grid has the
    same return sums and only its number of steps differs: nothing is materialised.
    """
    n = grid_steps(F.col("first.at"), F.col("last.at"), F.col("frequency"))
    stats = ctx.withColumn("_n", n).withColumn("_mu", F.col("r_sum") / F.col("_n")).withColumn(
        "_sd", F.sqrt(F.greatest(F.lit(0.0), F.col("r_squares") - F.col("_n") * F.col("_mu") * F.col("_mu")) / (F.col("_n") - 1))
    )
    df = horizons_of(stats.filter((F.col("_n") > 1) & (F.col("last.value") > 0)))
    h = F.col("horizon").cast("double")
    centre = F.ln(F.col("last.value")) + h * F.col("_mu")
    at = lambda q: F.exp(centre + F.lit(sc.Z_SCORES[q]) * F.col("_sd") * F.sqrt(h))
    return _predictions(df, "log_random_walk", point=F.exp(centre), quantiles=sc.quantiles_of(at))


def _trailing_or_all(ctx: DataFrame, observations: DataFrame, trailing: int | None, folds: dict[str, Column]) -> DataFrame:
    """Sum each fold over all visible rows, or over the trailing ``n`` of them."""
    if trailing is None:
        extra = {n: ("sum", e) for n, e in folds.items()}
        return asof.state_at(ctx, observations, KEY, "as_of", asof.released(), {"_n": asof.count_rows(), **extra})
    keys = ["spec_id", "task_id", "series_id", "as_of"]
    rows = asof.trailing_visible(ctx.select(*keys), observations, trailing)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(e).alias(n) for n, e in folds.items()])
    return ctx.join(sums, keys)


def historical_frequency(ctx: DataFrame, observations: DataFrame, trailing: int | None = None) -> DataFrame:
    """Share of ones in the visible 0/1 history (all of it, or the trailing ``n`` rows)."""
    ok = F.when(F.col("value").isin(0.0, 1.0), F.col("value")).otherwise(
        F.raise_error(F.lit("historical_frequency needs a 0/1 series")).cast("double")
    )
    df = _trailing_or_all(ctx, observations, trailing, {"_ones": ok}).filter(F.col("_n") > 0)
    name = "historical_frequency" if trailing is None else f"historical_frequency_{trailing}"
    return _predictions(horizons_of(df), name, probability=F.col("_ones") / F.col("_n"))


def category_frequency(
    ctx: DataFrame, observations: DataFrame, categories: Sequence[tuple[str, float]], trailing: int | None = None
) -> DataFrame:
    """Relative frequency of each category in the visible history; absent labels get zero."""
    folds = {
        f"_c{i}": F.when(sc.same_value(F.col("value"), F.lit(float(v))), F.lit(1)).otherwise(F.lit(0))
        for i, (_, v) in enumerate(categories)
    }
    df = _trailing_or_all(ctx, observations, trailing, folds).filter(F.col("_n") > 0)
    probs = F.map_from_arrays(
        F.array(*[F.lit(label) for label, _ in categories]),
        F.array(*[F.col(f"_c{i}") / F.col("_n") for i in range(len(categories))]),
    )
    name = "category_frequency" if trailing is None else f"category_frequency_{trailing}"
    return _predictions(horizons_of(df), name, probs=probs)


# --- recursive filters: the state at every date serves every origin ------------------


def _states(observations: DataFrame, frequency: str, smoother: filters.Filter) -> DataFrame:
    """A filter's state at every observed step of the filled calendar grid."""
    states = filters.states_along(fill_gaps(observations, frequency), smoother)
    # Interpolated steps know the value after the gap, so only steps with a value of their own are read.
    return states.join(observations.select("series_id", F.col("timestamp").alias("at")), ["series_id", "at"], "left_semi")


def _with_state(ctx: DataFrame, states: DataFrame) -> DataFrame:
    """Each origin with the state at its newest visible grid step; a last row off the grid leaves the step before it."""
    names = [c for c in states.columns if c not in ("series_id", "at")]
    probes = ctx.withColumn("_at", F.col("last.at"))
    newest = F.struct(F.col("at"), *names)
    found = asof.state_at(probes, states, KEY, "_at", F.col("at"), {"_state": ("max", newest)}).filter(F.col("_state").isNotNull())
    return horizons_of(found.select("*", *[F.col(f"_state.{n}").alias(n) for n in names]))


@cut_first
def exponential_smoothing(ctx: DataFrame, observations: DataFrame, frequency: str, period: int | None = None) -> DataFrame:
    """Simple smoothing, or additive trend and season when ``period`` is given."""
    h = F.col("horizon").cast("double")
    if period is None:
        df = _with_state(ctx, _states(observations, frequency, filters.SimpleSmoothing()))
        sd = F.col("sd") * F.sqrt(F.lit(1.0) + (h - 1) * F.col("gain") * F.col("gain"))
        return _predictions(df, "exponential_smoothing", point=F.col("level"), quantiles=sc.gaussian_quantiles(F.col("level"), sd))
    df = _with_state(ctx, _states(observations, frequency, filters.SeasonalSmoothing(period)))
    step = (F.col("horizon") - 1) % period
    mean = F.col("level") + h * F.col("trend") + F.element_at("season", step + 1)

    def weight(j: Column) -> Column:
        c = F.col("a") * (F.lit(1.0) + j * F.col("b")) + F.when(j % period == 0, F.col("g")).otherwise(F.lit(0.0))
        return c * c

    earlier = F.when(F.col("horizon") > 1, F.sequence(F.lit(1), F.col("horizon") - 1)).otherwise(F.array().cast("array<int>"))
    spread = F.aggregate(earlier, F.lit(1.0), lambda acc, j: acc + weight(j))
    return _predictions(df, "seasonal_smoothing", point=mean, quantiles=sc.gaussian_quantiles(mean, F.col("sd") * F.sqrt(spread)))


@cut_first
def kalman_local_level(ctx: DataFrame, observations: DataFrame, frequency: str) -> DataFrame:
    df = _with_state(ctx, _states(observations, frequency, filters.LocalLevel()))
    extra = (F.col("horizon") - 1).cast("double") * F.col("gain") * F.col("noise")
    sd = F.sqrt(F.col("sd") * F.col("sd") + F.col("gain") * F.col("noise") + extra)
    return _predictions(df, "kalman_local_level", point=F.col("level"), quantiles=sc.gaussian_quantiles(F.col("level"), sd))


# --- lagged regression: normal equations as running sums -----------------------------


def lag_table(observations: DataFrame, n_lags: int, max_horizon: int, covariates: DataFrame | None = None) -> DataFrame:
    """Feature rows ``x`` (intercept, lags, covariates at the row) and their later targets ``y_h``.

    ``known_at_h`` is when the h-step target is released, so a training row joins an
    origin's fit only once its outcome was visible.
    """
    back = lags(observations, KEY, "timestamp", {f"_l{i}": ("value", i) for i in range(1, n_lags)}) if n_lags > 1 else observations
    ahead = lags(
        back.withColumn("_rel", asof.released()), KEY, "timestamp",
        {f"_y{h}": ("value", h) for h in range(1, max_horizon + 1)} | {f"_k{h}": ("_rel", h) for h in range(1, max_horizon + 1)},
        ascending=False,
    )
    cov = [c for c in covariates.columns if c not in ("series_id", "timestamp")] if covariates is not None else []
    if cov:
        on = [c for c in ("series_id", "timestamp") if c in covariates.columns]
        if "series_id" in on and "root_id" in ahead.columns:
            covariates, on = covariates.withColumnRenamed("series_id", "root_id"), ["root_id", "timestamp"]
        ahead = ahead.join(covariates, on, "left")
    x = F.array(F.lit(1.0), F.col("value"), *[F.col(f"_l{i}") for i in range(1, n_lags)], *[F.col(c) for c in cov])
    return ahead.withColumn("x", F.when(~F.exists(x, lambda v: v.isNull()), x))


@F.pandas_udf(T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType())]))
def _solve(xtx: pd.Series, xty: pd.Series, yy: pd.Series, n: pd.Series, x: pd.Series) -> pd.DataFrame:
    out = np.full((len(n), 2), np.nan)
    for i, (a, b, s, m, row) in enumerate(zip(xtx, xty, yy, n, x)):
        k = len(b)
        beta, *_ = np.linalg.lstsq(np.reshape(a, (k, k)), np.asarray(b), rcond=None)
        rss = max(float(s - beta @ np.asarray(b)), 0.0)
        out[i] = float(beta @ np.asarray(row)), np.sqrt(rss / max(m - k, 1))
    return pd.DataFrame(out, columns=["mean", "sd"])


@cut_first
def lagged_regression(
    ctx: DataFrame, observations: DataFrame, horizons: Sequence[int], n_lags: int = 3, covariates: DataFrame | None = None
) -> DataFrame:
    """Direct least squares per horizon, refitted at every origin from running normal equations.

    Bands are Gaussian from the residual variance.
    """
    table = lag_table(observations, n_lags, max(horizons), covariates)
    k = n_lags + 1 + (len([c for c in covariates.columns if c not in ("series_id", "timestamp")]) if covariates is not None else 0)
    table = settled(table, "lags")  # read once per horizon and again for the newest features
    latest_x = asof.state_at(
        ctx, table.filter(F.col("x").isNotNull()), KEY, "as_of", asof.released(), {"_x": asof.latest("x")}
    ).filter(F.col("_x").isNotNull())
    out = None
    for h in horizons:
        y, x = F.col(f"_y{h}"), F.col("x")
        train = table.filter(x.isNotNull() & y.isNotNull())
        folds = {f"_a{i}_{j}": ("sum", x[i] * x[j]) for i in range(k) for j in range(i, k)}
        folds |= {f"_b{i}": ("sum", x[i] * y) for i in range(k)} | {"_yy": ("sum", y * y), "_m": asof.count_rows()}
        sums = asof.state_at(latest_x, train, KEY, "as_of", F.col(f"_k{h}"), folds)
        xtx = F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
        fit = _solve(xtx, F.array(*[F.col(f"_b{i}") for i in range(k)]), F.col("_yy"), F.col("_m"), F.col("_x.x"))
        here = sums.filter(F.col("_m") > 2 * k).withColumn("_fit", fit).withColumn("horizons", F.array(F.lit(h)))
        df = horizons_of(here)
        part = _predictions(
            df, "lagged_regression", point=F.col("_fit.mean"), quantiles=sc.gaussian_quantiles(F.col("_fit.mean"), F.col("_fit.sd"))
        )
        out = part if out is None else out.unionByName(part)
    return out


def known_covariates(observations: DataFrame, covariates: DataFrame, names: Sequence[str]) -> DataFrame:
    """``series_id, timestamp`` and one column per covariate: its newest value released by the time the row itself was.

    ``covariates`` are canonical rows of the series ``names``.  Values are looked up once per release moment, so
    the look-up is as long as the calendar however many series there are.
    """
    rows = observations.select("series_id", "timestamp", asof.released().alias("_at"))
    asked = rows.select("_at").distinct().withColumn("cov", F.explode(F.array(*[F.lit(n) for n in names])))
    values = covariates.filter(F.col("series_id").isin(*names)).withColumn("cov", F.col("series_id"))
    found = asof.state_at(asked, values, ["cov"], "_at", asof.released(), {"_c": asof.latest("value")})
    wide = found.groupBy("_at").agg(*[F.max(F.when(F.col("cov") == n, F.col("_c.value"))).alias(n) for n in names])
    return rows.join(wide, "_at").drop("_at")


@cut_first
def quantile_regression(
    ctx: DataFrame, observations: DataFrame, horizons: Sequence[int], n_lags: int = 3, covariates: DataFrame | None = None
) -> DataFrame:
    """Direct linear quantile regression per horizon and level, refitted at every origin on outcomes released by then.

    ``covariates`` is wide, as :func:`known_covariates` gives it; rows that lack one are neither fitted nor forecast.
    """
    table = settled(lag_table(observations, n_lags, max(horizons), covariates).filter(F.col("x").isNotNull()), "lags")
    k = n_lags + (len([c for c in covariates.columns if c not in ("series_id", "timestamp")]) if covariates is not None else 0)
    features = F.slice("x", 2, k)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h_ahead"), F.col(f"_k{h}").alias("known_at"), F.col(f"_y{h}").alias("y")) for h in horizons]))
    examples = table.select("series_id", features.alias("x"), each.alias("e")).select("series_id", "e.*", "x").filter(F.col("y").isNotNull())
    here = asof.state_at(ctx, table, KEY, "as_of", asof.released(), {"_x": asof.latest("x")}).filter(F.col("_x").isNotNull())
    here = here.withColumn("horizons", F.array(*[F.lit(h) for h in horizons])).withColumn("now", F.slice("_x.x", 2, k)).drop("_x")
    here = settled(horizons_of(here).withColumn("_id", F.monotonically_increasing_id()), "origins")
    fits = quantreg.fit_quantiles(here.select("_id", "series_id", F.col("horizon").cast("int").alias("h_ahead"), "as_of", "now"), examples, k)
    df = here.join(fits.withColumnRenamed("quantiles", "_q"), "_id")
    q = sc.quantiles_from_array(F.col("_q"))
    told = F.when(~F.col("converged"), F.lit("not converged"))
    return _predictions(df, "quantile_regression", point=sc.quantile_at(q, 0.5), quantiles=q, metadata=told)


def refit_dates(ctx: DataFrame, months: int = 12) -> list[dt.datetime]:
    """The first origin and every ``months`` months after it, up to the last origin."""
    span = ctx.agg(F.min("as_of").alias("lo"), F.max("as_of").alias("hi"))
    found = span.select(F.sequence("lo", "hi", F.make_ym_interval(F.lit(0), F.lit(months))).alias("cuts")).first()
    return found["cuts"] or []


def boosted_regression(
    ctx: DataFrame, observations: DataFrame, horizons: Sequence[int], n_lags: int = 3, covariates: DataFrame | None = None, *,
    refits: Sequence[dt.datetime] | None = None, n_trees: int = 20, depth: int = 2, rate: float = 0.2,
) -> DataFrame:
    """Gradient-boosted quantile trees per horizon, refitted at dates on outcomes released by then.

    An origin is served by the last refit at or before it; the default (:func:`refit_dates`) is the first origin and
    each year after, so every origin has one.  An origin has no row if nothing was known to fit on at its refit, or its features lack a value.
    One model serves all series: differences from the current value are in units of its size.  Each refit gets its own copy of
    the rows it may see, so rows are copied once per later refit.  ``covariates`` is wide, as :func:`known_covariates` gives it.
    """
    cuts = sorted(refits) if refits is not None else refit_dates(ctx)
    cov = [c for c in covariates.columns if c not in ("series_id", "timestamp")] if covariates is not None else []
    k = n_lags + len(cov)
    each_cut = F.array(*[F.lit(c).cast("timestamp_ntz") for c in cuts]) if cuts else F.array().cast("array<timestamp_ntz>")

    def scaled(rows: DataFrame) -> DataFrame:
        lagged = lag_table(rows, n_lags, max(horizons), covariates).filter(F.col("x").isNotNull())
        size = F.when(F.col("value") == 0, F.lit(1.0)).otherwise(F.abs("value"))
        past = [(F.col(f"_l{i}") - F.col("value")) / size for i in range(1, n_lags)]
        x = F.array(*past, F.month("timestamp").cast("double"), *[F.col(f"`{c}`").cast("double") for c in cov])
        return lagged.withColumn("size", size).withColumn("features", x)

    @cut_first
    def newest(ctx: DataFrame, rows: DataFrame) -> DataFrame:
        return asof.state_at(ctx, scaled(rows), KEY, "as_of", asof.released(), {"_x": asof.latest("value", "size", "features")})

    asked = observations.select("series_id").distinct().select("series_id", F.explode(each_cut).alias("as_of"))
    _, seen = asof.vintages(asked, observations)
    cut = F.array_position(each_cut, F.rtrim(F.substring("series_id", 1, asof.STAMP)).cast("timestamp_ntz")) - 1
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_y{h}").alias("y")) for i, h in enumerate(horizons)]))
    train = scaled(settled(seen, "vintages")).select(cut.alias("cut"), "value", "size", "features", ahead.alias("e")).filter("e.y IS NOT NULL")
    examples = train.select(
        (F.col("cut") * len(horizons) + F.col("e.i")).cast("int").alias("model"), F.col("features").alias("x"),
        ((F.col("e.y") - F.col("value")) / F.col("size")).alias("y"),
    )
    forest = boosting.fit_forest(examples, len(cuts) * len(horizons), k, n_trees=n_trees, depth=depth, rate=rate)
    here = newest(ctx, observations).withColumn("_cut", F.size(F.filter(each_cut, lambda c: c <= F.col("as_of"))) - 1)
    here = here.filter(F.col("_x").isNotNull() & (F.col("_cut") >= 0)).withColumn("horizons", F.array(*[F.lit(h) for h in horizons]))
    df = horizons_of(settled(here, "newest"))
    model = (F.col("_cut") * len(horizons) + F.array_position(F.array(*[F.lit(h) for h in horizons]), F.col("horizon")) - 1).cast("int")
    df = df.withColumn("_model", model).withColumn("_q", boosting.forecast_with(forest, F.col("_model"), F.col("_x.features"))).filter(F.col("_q").isNotNull())
    q = sc.quantiles_from_array(F.transform("_q", lambda v: F.col("_x.value") + F.col("_x.size") * v))
    n_train = F.get(F.array(*[F.lit(int(n)) for n in forest.n]), F.col("_model")) if cuts else F.lit(0)
    told = F.to_json(F.struct(F.get(each_cut, F.col("_cut")).cast("string").alias("refit"), n_train.alias("n_train")))
    return _predictions(df, "boosted_regression", point=sc.quantile_at(q, 0.5), quantiles=q, metadata=told)


# --- stored forecasts ---------------------------------------------------------------


def from_samples(samples: DataFrame, expected: int | Column, keys: Sequence[str], *, large_groups: bool = False) -> DataFrame:
    """Sampled trajectories (``values`` arrays, one row per sample) to quantiles per step.

    Trajectories of the wrong length are dropped.  Adds ``step, n_samples, point, quantiles``.
    A forecast has some hundreds of samples, which one aggregate buffer holds; set
    ``large_groups`` when keys may gather many rows, and the values are ranked instead.
    """
    n = F.lit(expected) if isinstance(expected, int) else expected
    steps = samples.filter(F.size("values") == n).select(*keys, F.posexplode("values").alias("_pos", "_v"))
    steps = steps.select(*keys, (F.col("_pos") + 1).alias("step"), F.col("_v").cast("double").alias("_v"))
    by = [*keys, "step"]
    if large_groups:
        levels = {f"q{i}": q for i, q in enumerate(sc.QUANTILE_LEVELS)}
        ranked = exact_percentiles(steps, by, "_v", levels).select(*by, F.array(*levels).alias("_q"))
        agg = steps.groupBy(*by).agg(F.count("_v").alias("n_samples")).join(ranked, by)
    else:
        levels = F.array(*[F.lit(q) for q in sc.QUANTILE_LEVELS])
        agg = steps.groupBy(*by).agg(F.count("_v").alias("n_samples"), F.percentile("_v", levels).alias("_q"))
    quantiles = sc.quantiles_from_array(F.col("_q"))
    return agg.withColumn("quantiles", quantiles).withColumn("point", sc.quantile_at(quantiles, 0.5)).drop("_q")


def parse_responses(responses: DataFrame, text: str, schema: str) -> DataFrame:
    """Stored model responses to a struct: fences stripped, first JSON object kept, bad rows flagged."""
    parsed = F.from_json(first_json_object(F.col(text)), schema, {"mode": "PERMISSIVE"})
    return responses.withColumn("parsed", parsed).withColumn("parse_failed", F.col("parsed").isNull())


def scenario_rows(df: DataFrame, probability: str, keys: Sequence[str]) -> DataFrame:
    """Total probability of the scenarios in each forecast, capped at one."""
    return df.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(probability)).alias("probability"), F.count(F.lit(1)).alias("n_scenarios"))


def horizon_mismatches(forecasts: DataFrame, tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, extra and duplicate horizons of each forecast set against its task."""
    have = forecasts.groupBy(*keys, "task_id").agg(F.collect_set("horizon").alias("_set"), F.count(F.lit(1)).alias("_n"))
    both = have.join(tasks.select("task_id", "horizons"), "task_id")
    return both.select(
        *keys, "task_id",
        F.size(F.array_except("horizons", "_set")).alias("n_missing"),
        F.size(F.array_except("_set", "horizons")).alias("n_extra"),
        (F.col("_n") - F.size("_set")).cast("int").alias("n_duplicate"),
    )


def band_to_quantiles(df: DataFrame, mean: str, lower: str, upper: str) -> DataFrame:
    """Point plus 95 % band to Gaussian quantiles, deviation floored at 1e-4."""
    sigma = F.greatest(sc.sigma_from_band(F.col(lower), F.col(upper)), F.lit(1e-4))
    return df.withColumn("quantiles", sc.gaussian_quantiles(F.col(mean), sigma))


def band_shock_probability(mean: Column, lower: Column, upper: Column, level: Column) -> Column:
    """``P(X > level)`` from a 95 % band; a collapsed band gives 0 or 1."""
    from tidemark.functions.stats import normal_cdf

    sigma = sc.sigma_from_band(lower, upper)
    p = F.lit(1.0) - normal_cdf((level - mean) / sigma)
    return F.when(sigma <= 0, F.when(mean > level, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def with_patterns(base: DataFrame, fired: DataFrame) -> DataFrame:
    """Climatology overridden by the best precision among patterns firing on the origin's day.

    ``fired``: ``series_id, day, pattern_id, train_precision``.
    """
    best = fired.groupBy("series_id", "day").agg(F.max("train_precision").alias("_p"), F.array_join(F.sort_array(F.collect_set("pattern_id")), ",").alias("_ids"))
    joined = base.withColumn("day", F.to_date("as_of")).join(best, ["series_id", "day"], "left")
    return (
        joined.withColumn("predictor_id", F.lit("climatology_patterns"))
        .withColumn("probability", F.coalesce("_p", "probability"))
        .withColumn("metadata", F.to_json(F.struct(F.coalesce("_ids", F.lit("")).alias("patterns_fired"))))
        .select(*PREDICTION_COLUMNS)
    )


def one_forecast(ctx: DataFrame, observations: DataFrame, series_id: str, as_of: str, forecaster=last_value) -> DataFrame:
    """A single on-demand forecast with its 80 and 90 % intervals."""
    one = ctx.filter((F.col("series_id") == series_id) & (F.col("as_of") == F.lit(as_of).cast("timestamp_ntz")))
    return with_intervals(forecaster(one, observations))


def with_intervals(predictions: DataFrame) -> DataFrame:
    i80, i90 = sc.central_interval(F.col("quantiles"), 0.80), sc.central_interval(F.col("quantiles"), 0.90)
    return predictions.withColumn("lo80", i80["lo"]).withColumn("hi80", i80["hi"]).withColumn("lo90", i90["lo"]).withColumn("hi90", i90["hi"])


# --- macro features and fit-at-origin classification -----------------------------------

MACRO_FEATURES = ("yield_spread", "rate_momentum", "inflation_gap", "unemployment_momentum")


def macro_features(probes: DataFrame, rate: DataFrame, bond: DataFrame, prices: DataFrame, unemployment: DataFrame) -> DataFrame:
    """Leak-safe macro vector at every probe ``as_of`` (one series per input, columns as observations).

    Daily inputs are read at ``as_of - 1 day`` (the rate also 90 days before that); monthly inputs drop their newest visible
    row, so positions 2 and 14 from the end stand for "now" and "a year ago".  All inputs go through one as-of
    fold: a row carries its stream's name and the first moment at which a probe may read it, and rows and probes meet by blocks of time.
    """
    def stream(rows: DataFrame, name: str, delay: int, now: str = "value", then: str | None = None) -> DataFrame:
        value = F.struct(F.col("timestamp").alias("at"), F.col(now).alias("now"), (F.col(then) if then else F.lit(None)).cast("double").alias("then"))
        return rows.select(F.lit(name).alias("stream"), cal.plus_days("timestamp", delay).alias("from"), value.alias("row"))

    def monthly(rows: DataFrame, name: str) -> DataFrame:
        return stream(lags(rows.select(*KEY, "timestamp", "value"), KEY, "timestamp", {"_now": ("value", 1), "_then": ("value", 13)}), name, 0, "_now", "_then")

    rows = stream(rate, "rate", 1).unionByName(stream(rate, "rate_then", 91)).unionByName(stream(bond, "bond", 1))
    rows = rows.unionByName(monthly(prices, "cpi")).unionByName(monthly(unemployment, "un"))
    folds = {f"_{n}": ("max", F.when(F.col("stream") == n, F.col("row"))) for n in ("rate", "rate_then", "bond", "cpi", "un")}
    found = asof.state_at(probes.drop("series_id"), rows, [], "as_of", F.col("from"), folds)
    return found.select(
        *[c for c in probes.columns if c != "series_id"],
        (F.col("_bond.now") - F.col("_rate.now")).alias("yield_spread"),
        (F.col("_rate.now") - F.col("_rate_then.now")).alias("rate_momentum"),
        ((F.col("_cpi.now") / F.col("_cpi.then") - 1) * 100 - 2.0).alias("inflation_gap"),
        (F.col("_un.now") - F.col("_un.then")).alias("unemployment_momentum"),
    )


def best_per_task(leaderboard: DataFrame) -> DataFrame:
    """The predictor with the lowest mean score of each task."""
    return leaderboard.groupBy("task_id").agg(F.min_by("predictor_id", "mean_score").alias("predictor_id"), F.min("mean_score").alias("mean_score"))


def session_dates(predictions: DataFrame) -> DataFrame:
    """Forecasts made after the close resolve on the session's date: drop the time of day."""
    return predictions.withColumn("forecast_date", cal.midnight("forecast_date"))


def price_outcome(origins: DataFrame, prices: DataFrame, threshold: float, horizon: int) -> DataFrame:
    """Did the price rise by more than ``threshold`` from the first session at/after the origin to the h-th session after it?"""
    later = lags(prices, KEY, "timestamp", {f"_h{i}": ("value", i) for i in (horizon - 1, horizon) if i > 0}, ascending=False)
    ahead = lambda i: F.col("value") if i == 0 else F.col(f"_h{i}")
    # A history that ends early is read at its last session.
    final = prices.groupBy("series_id").agg(F.max(F.struct("timestamp", "value")).alias("_final"))
    later = later.join(final, "series_id")
    last = F.when(F.col("timestamp") < F.col("_final.timestamp"), F.col("_final.value"))
    on_last = F.coalesce(ahead(horizon - 1), F.col("_final.value"))
    later = later.withColumn("_strict", on_last).withColumn("_on", F.coalesce(ahead(horizon), last))
    found = asof.state_at(
        origins, later, KEY, "as_of", F.col("timestamp"), {"_s": asof.earliest("value", "_strict", "_on")}, forward=True
    ).filter(F.col("_s").isNotNull())
    # The horizon counts sessions strictly after the origin, so an origin that is itself a session starts one later.
    end = F.when(F.col("_s.at") == F.col("as_of"), F.col("_s._on")).otherwise(F.col("_s._strict"))
    delta = end - F.col("_s.value")
    return found.withColumn("delta", delta).withColumn("outcome", (delta > threshold).cast("int")).drop("_s")


