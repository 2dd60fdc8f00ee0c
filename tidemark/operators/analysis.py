"""Tables over scored predictions.

All take the ``scored`` frame (predictions + ``actual, metric, score``) or an aligned
frame, and reduce with hash aggregates that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import calendar as cal, scoring as sc
from tidemark.functions.stats import safe_ratio
from tidemark.operators import asof, forecast
from tidemark.operators.ordered import exact_percentiles, lags, running, trailing, value_blocks

# Name fragments that place a predictor in a family, checked in order.
FAMILY_FRAGMENTS = (
    (("naive", "last value"), "Baseline"),
    (("arima", "lightgbm", "prophet"), "Numerical ML"),
    (("llmp", "agent", "news", "llm"), "LLM / Agent"),
)


def predictor_family(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for fragments, label in FAMILY_FRAGMENTS:
        hit = None
        for f in fragments:
            hit = low.contains(f) if hit is None else hit | low.contains(f)
        out = (out if out is not None else F).when(hit, F.lit(label))
    return out.otherwise(F.lit("Other"))


def longest_prefix_label(df: DataFrame, name: str, labels: dict[str, str], out: str = "arm") -> DataFrame:
    """Label by the longest known prefix (whole name or followed by ``_``); else the name in words."""
    expr = None
    for prefix in sorted(labels, key=len, reverse=True):
        hit = (F.col(name) == prefix) | F.col(name).startswith(prefix + "_")
        expr = (expr if expr is not None else F).when(hit, F.lit(labels[prefix]))
    words = F.replace(F.col(name), F.lit("_"), F.lit(" "))
    return df.withColumn(out, expr.otherwise(words) if expr is not None else words)


def aligned(resolved: DataFrame) -> DataFrame:
    """Tidy per-prediction frame: errors, 80 % interval, width, coverage.  Unresolved rows keep null errors."""
    band = sc.central_interval(F.col("quantiles"), 0.80)
    a = F.col("actual")
    return (
        resolved.withColumn("lo80", band["lo"])
        .withColumn("hi80", band["hi"])
        .withColumn("width80", F.col("hi80") - F.col("lo80"))
        .withColumn("error", F.col("point") - a)
        .withColumn("abs_error", F.abs("error"))
        .withColumn("inside80", a.between(F.col("lo80"), F.col("hi80")).cast("double"))
        .withColumn("ape", F.when(a != 0, F.abs("error") / F.abs(a) * 100))
        .withColumn("family", predictor_family(F.col("predictor_id")))
    )


def leaderboard(scored: DataFrame, keys: Sequence[str] = ("predictor_id",)) -> DataFrame:
    """Mean score, standard error and count; lower is better."""
    return (
        scored.groupBy(*keys)
        .agg(
            F.avg("score").alias("mean_score"),
            (F.stddev_samp("score") / F.sqrt(F.count("score"))).alias("se"),
            F.count("score").alias("n"),
        )
        .withColumn("family", predictor_family(F.col("predictor_id")))
    )


def with_skill(board: DataFrame, reference_id: str, on: Sequence[str] = (), score: str = "mean_score") -> DataFrame:
    """``1 - score / reference score`` rounded to 4 places; null when the reference is not positive.

    The reference has one row per combination of ``on`` (one row in all without it).
    """
    ref = board.filter(F.col("predictor_id") == reference_id).select(*on, F.col(score).alias("_ref"))
    joined = board.join(ref, list(on), "left") if on else board.join(F.broadcast(ref.agg(F.first("_ref").alias("_ref"))))
    return joined.withColumn("skill_vs_reference", F.round(F.lit(1.0) - safe_ratio(F.col(score), F.when(F.col("_ref") > 0, F.col("_ref"))), 4)).drop("_ref")


def top_predictors(board: DataFrame, n: int) -> DataFrame:
    return board.orderBy(F.asc_nulls_last("mean_score"), "predictor_id").limit(n)


def horizon_matrix(scored: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Predictor x horizon mean scores with an ``All`` column pooling rows."""
    levels = F.explode(F.array(F.col("horizon").cast("string"), F.lit("All"))).alias("_h")
    long = scored.select("predictor_id", "score", levels)
    return long.groupBy("predictor_id").pivot("_h", [str(h) for h in horizons] + ["All"]).agg(F.avg("score"))


def task_matrix(scored: DataFrame, tasks: Sequence[str], predictors: Sequence[str], column: str = "score") -> DataFrame:
    """Task x predictor means with a ``MEAN`` row averaging the task means (not the rows)."""
    means = scored.groupBy("task_id", "predictor_id").agg(F.avg(column).alias("_m"))
    both = means.select(F.explode(F.array(F.col("task_id"), F.lit("MEAN"))).alias("task_id"), "predictor_id", "_m")
    return both.groupBy("task_id").pivot("predictor_id", list(predictors)).agg(F.avg("_m"))


def by_group(scored: DataFrame, by: Column, name: str, column: str = "score") -> DataFrame:
    return scored.groupBy("predictor_id", by.alias(name)).agg(F.avg(column).alias("mean_score"), F.count(column).alias("n"))


def score_summary(frame: DataFrame, mae_horizon: int) -> DataFrame:
    """Mean score over everything, MAE at one horizon, and q10-q90 coverage in percent."""
    at = F.col("horizon") == mae_horizon
    return frame.groupBy("predictor_id").agg(
        F.avg("score").alias("mean_score"),
        F.avg(F.when(at, F.col("abs_error"))).alias("mae"),
        (F.avg("inside80") * 100).alias("coverage_80"),
    )


def coverage_table(frame: DataFrame) -> DataFrame:
    """Coverage against sharpness per family, predictor and horizon."""
    return frame.groupBy("family", "predictor_id", "horizon").agg(
        (F.avg("inside80") * 100).alias("coverage"),
        F.avg("width80").alias("width"),
        F.avg("score").alias("mean_score"),
        F.count("score").alias("n"),
        (F.avg("inside80") * 100 - 80).alias("miscalibration"),
    )


def error_by_period(frame: DataFrame, period: Column) -> DataFrame:
    keys = ["predictor_id", "period"]
    dated = frame.withColumn("period", period)
    means = dated.groupBy(*keys).agg(
        F.count("abs_error").alias("n"),
        (F.avg("inside80") * 100).alias("coverage"),
        F.avg("abs_error").alias("mean_abs_error"),
        F.max("abs_error").alias("max_abs_error"),
    )
    return means.join(exact_percentiles(dated, keys, "abs_error", {"median_abs_error": 0.5}), keys, "left")


def bin_edges(n_bins: int) -> list[float]:
    """Equal-width edges over [0, 1], each the exact double of ``k * (1 / n)``, last edge 1."""
    return [k * (1.0 / n_bins) for k in range(n_bins)] + [1.0]


def calibration(frame: DataFrame, n_bins: int = 5, keys: Sequence[str] = ("predictor_id",)) -> DataFrame:
    """Reliability table: bins are ``[left, right)``, the last one closed; empty bins are absent."""
    edges = bin_edges(n_bins)
    p = F.col("probability")
    which = None
    for k in range(n_bins):
        inside = (p >= edges[k]) & (p <= edges[k + 1] if k == n_bins - 1 else p < edges[k + 1])
        which = (which if which is not None else F).when(inside, F.lit(k))
    left = F.array(*[F.lit(e) for e in edges])
    return (
        frame.filter(p.isNotNull() & F.col("outcome").isNotNull())
        .withColumn("_bin", which)
        .filter(F.col("_bin").isNotNull())
        .groupBy(*keys, "_bin")
        .agg(F.avg("probability").alias("mean_predicted"), F.avg("outcome").alias("observed_frequency"), F.count(F.lit(1)).alias("n"))
        .withColumn("bin_left", left[F.col("_bin")])
        .withColumn("bin_right", left[F.col("_bin") + 1])
        .drop("_bin")
    )


def yearly_outcomes(events: DataFrame, labels: dict[str, float], rate_of: str | None = None) -> DataFrame:
    """Events per year with one count per label, and the rate of one label."""
    counts = [F.count_if(sc.same_value(F.col("value"), F.lit(float(v)))).alias(f"n_{k}") for k, v in labels.items()]
    out = events.groupBy("series_id", F.year("timestamp").alias("year")).agg(F.count("value").alias("n_events"), *counts)
    if rate_of:
        out = out.withColumn(f"{rate_of}_rate", F.round(F.col(f"n_{rate_of}") / F.col("n_events"), 3))
    return out


def class_shares(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each label; totals come from the label counts, not from the rows again."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def _auc(df: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """ROC-AUC by rank sums with ties averaged.

    Rows are first reduced to one per distinct score, and the cumulative pass runs over score
    ranges, so a key with very many rows or scores stays spread out.
    """
    per_score = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(F.col(truth)).alias("_pos"), F.sum(F.lit(1.0) - F.col(truth)).alias("_neg")
    )
    blocked = value_blocks(per_score, keys, "_s")
    cumulated = running(blocked, keys, "_s", {"_upto": ("sum", F.col("_neg"))}, block=F.col("_bucket"))
    ranked = cumulated.withColumn("_below", F.col("_upto") - F.col("_neg"))
    wins = ranked.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_w"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    return wins.select(*keys, safe_ratio(F.col("_w"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def binary_metrics(
    df: DataFrame, keys: Sequence[str], truth: str = "actual_up", predicted: str = "pred_up", score: str | None = "prob_up"
) -> DataFrame:
    """Classification metrics from one pass of confusion counts (0 where a ratio is undefined), plus ROC-AUC."""
    y, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    c = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = F.col("n").cast("double")
    zero = 0.0

    def prf(hit: Column, false_alarm: Column, miss: Column, side: str) -> dict[str, Column]:
        return {
            f"precision_{side}": safe_ratio(hit, hit + false_alarm, zero),
            f"recall_{side}": safe_ratio(hit, hit + miss, zero),
            f"f1_{side}": safe_ratio(hit * 2, hit * 2 + false_alarm + miss, zero),
        }

    expected = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    observed = (tp + tn) / n
    recalls = [safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)]
    present = F.array_compact(F.array(*recalls))
    metrics = {
        "prevalence_up": (tp + fn) / n,
        "accuracy": observed,
        "balanced_accuracy": F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.size(present),
        **prf(tp, fp, fn, "up"),
        **prf(tn, fn, fp, "down"),
        "matthews_corrcoef": safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), zero),
        "cohen_kappa": safe_ratio(observed - expected, F.lit(1.0) - expected),
        "majority_baseline": F.greatest((tp + fn) / n, (tn + fp) / n),
    }
    out = c.select("*", *[v.alias(k) for k, v in metrics.items()])
    if score is None:
        return out
    auc = _auc(df.withColumn(truth, F.col(truth).cast("double")), keys, score, truth)
    return out.join(auc, list(keys), "left")


def direction_frame(resolved: DataFrame) -> DataFrame:
    """Up/down view of continuous forecasts of a return: P(up) from the quantiles, point sign, realised sign."""
    return resolved.filter(F.col("payload_type") == "continuous").select(
        "*",
        sc.prob_above(F.col("quantiles"), 0.0).alias("prob_up"),
        (F.col("actual") > 0).cast("int").alias("actual_up"),
        (F.col("point") > 0).cast("int").alias("pred_up"),
    )


def direction_leaderboard(scored: DataFrame, covariates: DataFrame) -> DataFrame:
    """Scores and direction metrics per predictor and longest task horizon, with covariate columns.

    ``covariates``: ``predictor_id, covariate``.
    """
    tasks = scored.groupBy("predictor_id", "task_id", "series_id").agg(
        F.max("horizon").alias("horizon"), F.avg("score").alias("mean_crps"), F.count("score").alias("n_scores")
    )
    direction = binary_metrics(direction_frame(scored), ["predictor_id", "task_id"]).select(
        "predictor_id", "task_id", F.col("accuracy").alias("dir_accuracy"), F.col("roc_auc").alias("dir_roc_auc")
    )
    used = covariates.groupBy("predictor_id").agg(F.count(F.lit(1)).alias("_nc"), F.array_join(F.sort_array(F.collect_set("covariate")), ", ").alias("_cv"))
    return (
        tasks.join(direction, ["predictor_id", "task_id"], "left")
        .join(used, "predictor_id", "left")
        .withColumn("n_covariates", F.coalesce("_nc", F.lit(0).cast("long")))
        .withColumn("uses_covariates", F.col("n_covariates") > 0)
        .withColumn("covariates", F.coalesce("_cv", F.lit("—")))
        .drop("_nc", "_cv")
    )


def average_yoy(predictions: DataFrame, observations: DataFrame) -> DataFrame:
    """Average-over-average change per origin: next year's mean forecast over this year's mean.

    Needs at least 12 observations in the origin's year and, for ``actual_yoy``, exactly
    12 in the next.  ``yoy_q25`` / ``yoy_q75`` read the 0.20 / 0.80 levels, as published.
    """
    years = observations.groupBy("series_id", F.year("timestamp").alias("_y")).agg(F.avg("value").alias("_avg"), F.count("value").alias("_n"))
    at = lambda q: F.coalesce(sc.quantile_at(F.col("quantiles"), q), F.col("point"))
    named = {"yoy_q05": 0.05, "yoy_q25": 0.20, "yoy_q75": 0.80, "yoy_q95": 0.95}
    ahead = predictions.filter(F.year("forecast_date") == F.year("as_of") + 1)
    means = ahead.groupBy("predictor_id", "task_id", "series_id", "as_of").agg(
        F.avg("point").alias("predicted_avg_y1"), *[F.avg(at(q)).alias(n) for n, q in named.items()]
    ).withColumn("origin_year", F.year("as_of"))
    y0 = years.select("series_id", F.col("_y").alias("origin_year"), F.col("_avg").alias("actual_avg_y0"), F.col("_n").alias("_n0"))
    y1 = years.select("series_id", (F.col("_y") - 1).alias("origin_year"), F.col("_avg").alias("_avg1"), F.col("_n").alias("_n1"))
    base = F.col("actual_avg_y0")
    return (
        means.join(y0.filter("_n0 >= 12").drop("_n0"), ["series_id", "origin_year"])
        .join(y1, ["series_id", "origin_year"], "left")
        .withColumn("yoy_median", F.col("predicted_avg_y1") / base - 1)
        .withColumns({n: F.col(n) / base - 1 for n in named})
        .withColumn("actual_yoy", F.when(F.col("_n1") == 12, F.col("_avg1") / base - 1))
        .drop("_avg1", "_n1")
    )


def ape_distribution(frame: DataFrame, keys: Sequence[str] = ("predictor_id", "task_id")) -> DataFrame:
    five = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    counts = frame.groupBy(*keys).agg(F.count("ape").alias("n"))
    return counts.join(exact_percentiles(frame, keys, "ape", five), list(keys))


# --- paired comparison ------------------------------------------------------------------


def shared_origins(scored: DataFrame, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """Rows on origins every predictor of the group was scored on."""
    need = scored.select(*keys, "predictor_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_need"))
    have = scored.select(*keys, "as_of", "predictor_id").distinct().groupBy(*keys, "as_of").agg(F.count(F.lit(1)).alias("_have"))
    full = have.join(need, list(keys)).filter("_have = _need").select(*keys, "as_of")
    return scored.join(full, [*keys, "as_of"], "left_semi")


def dropped_origins(origins: DataFrame, scored: DataFrame, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """How many requested origins fall outside the shared set."""
    kept = shared_origins(scored, keys).select(*keys, "as_of").distinct()
    asked = origins.select(*keys, "as_of").distinct()
    return asked.join(kept, [*keys, "as_of"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dropped"))


def paired_differences(scored: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Score of ``a`` minus score of ``b`` on every key both have: one aggregate, no self-join."""
    pick = lambda p: F.max(F.when(F.col("predictor_id") == p, F.col("score")))
    wide = scored.filter(F.col("predictor_id").isin(a, b)).groupBy(*keys).agg(pick(a).alias("_a"), pick(b).alias("_b"))
    return wide.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(*keys, (F.col("_a") - F.col("_b")).alias("diff"))


def paired_test(differences: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference, its standard error and the share where ``a`` scored lower."""
    return differences.groupBy(*by).agg(
        F.count("diff").alias("n"),
        F.avg("diff").alias("mean_diff"),
        (F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("se"),
        F.avg((F.col("diff") < 0).cast("double")).alias("share_better"),
    )


def concentration(scored: DataFrame, k: int, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """Share of the total score carried by the ``k`` worst origins.

    Works on origin totals; the top-k rank is limited before its shuffle.
    """
    per_origin = scored.groupBy(*keys, "as_of").agg(F.sum("score").alias("_s"))
    totals = per_origin.groupBy(*keys).agg(F.sum("_s").alias("_total"), F.count(F.lit(1)).alias("n_origins"))
    worst = Window.partitionBy(*keys).orderBy(F.col("_s").desc(), F.col("as_of"))
    top = per_origin.withColumn("_r", F.row_number().over(worst)).filter(F.col("_r") <= k).groupBy(*keys).agg(F.sum("_s").alias("_top"))
    return totals.join(top, list(keys)).withColumn("worst_share", F.col("_top") / F.col("_total")).drop("_top", "_total")


def without_worst_origin(scored: DataFrame, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """Mean score per predictor with the single most costly origin left out."""
    per_origin = scored.groupBy(*keys, "as_of").agg(F.sum("score").alias("_s"))
    worst = per_origin.groupBy(*keys).agg(F.max(F.struct(F.col("_s"), (-F.unix_micros(F.col("as_of").cast("timestamp"))).alias("_first"), "as_of")).alias("_w"))
    bad = worst.select(*keys, F.col("_w.as_of").alias("as_of"))
    rest = scored.join(bad, [*keys, "as_of"], "left_anti")
    return rest.groupBy(*keys, "predictor_id").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))


def worst_rows(scored: DataFrame, n: int, column: str = "score") -> DataFrame:
    return scored.orderBy(F.col(column).desc_nulls_last(), "predictor_id", "series_id", "as_of", "horizon").limit(n)


def lead_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two leaderboards side by side with their difference."""
    a = left.select("predictor_id", F.col("mean_score").alias("score_a"))
    b = right.select("predictor_id", F.col("mean_score").alias("score_b"))
    return a.join(b, "predictor_id").withColumn("difference", F.col("score_b") - F.col("score_a"))


def winner_gap(scored: DataFrame) -> DataFrame:
    """Winner and runner-up with their gap against the sum of their standard errors.

    Two rows of the leaderboard are folded into one by aggregates.
    """
    two = leaderboard(scored).orderBy("mean_score").limit(2)
    row = two.agg(
        F.min(F.struct("mean_score", "predictor_id", "se")).alias("_w"), F.max(F.struct("mean_score", "predictor_id", "se")).alias("_r")
    )
    gap = F.col("_r.mean_score") - F.col("_w.mean_score")
    noise = F.coalesce("_w.se", F.lit(0.0)) + F.coalesce("_r.se", F.lit(0.0))
    return row.select(
        F.col("_w.predictor_id").alias("winner"), F.col("_r.predictor_id").alias("runner_up"),
        gap.alias("gap"), noise.alias("noise"), ((noise > 0) & (gap > noise)).alias("significant"),
    )


def decisive_horizon(scored: DataFrame) -> DataFrame:
    """Score range per horizon, widest flagged."""
    spread = scored.groupBy("horizon").agg((F.max("score") - F.min("score")).alias("spread"))
    top = spread.agg(F.max(F.struct("spread", "horizon")).alias("_t"))
    return spread.join(F.broadcast(top)).withColumn("decisive", F.col("horizon") == F.col("_t.horizon")).drop("_t")


# --- horizon / regime error report --------------------------------------------------------

REGIME_CUTS = ((15.0, "low"), (30.0, "medium"), (50.0, "elevated"))  # fixed values: annualised percent
MIN_VOL_ROWS = 5


def volatility_regime(origins: DataFrame, prices: DataFrame, lookback: int = 21) -> DataFrame:
    """Annualised volatility label of the last ``lookback`` prices stamped at/before each origin.

    The window is a fixed number of rows, so it is computed once per price row and read
    at the origins with an as-of join.
    """
    def step(w):
        return {"_step": F.ln(F.col("value")) - F.ln(F.lag("value").over(w))}

    def vol(w):
        frame = w.rowsBetween(-(lookback - 2), 0)
        return {"_sd": F.stddev_pop("_step").over(frame), "_rows": F.count("value").over(w.rowsBetween(-(lookback - 1), 0))}

    labelled = trailing(prices, ["series_id"], "timestamp", lookback, [step, vol])
    annual = F.col("_v._sd") * F.lit(252.0**0.5) * 100
    label = F.when(F.col("_v").isNull() | (F.col("_v._rows") < MIN_VOL_ROWS), F.lit("unknown"))
    for cut, name in REGIME_CUTS:
        label = label.when(annual < cut, F.lit(name))
    found = asof.state_at(origins, labelled, ["series_id"], "as_of", F.col("timestamp"), {"_v": asof.latest("_sd", "_rows")})
    return found.withColumn("annual_vol", annual).withColumn("regime", label.otherwise(F.lit("extreme"))).drop("_v")


def error_report(frame: DataFrame, keys: Sequence[str] = ("predictor_id", "horizon")) -> DataFrame:
    """Coverage, bias, error, interval width and the half-width that would have covered 80 %."""
    done = F.col("abs_error").isNotNull()
    report = frame.groupBy(*keys).agg(
        F.count("abs_error").alias("n_resolved"),
        F.count_if(~done).alias("n_unresolved"),
        F.avg("inside80").alias("coverage"),
        F.avg("error").alias("mean_bias"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.when(done, F.col("width80"))).alias("ci_width"),
    )
    report = report.join(exact_percentiles(frame, keys, "abs_error", {"needed_half_width": 0.8}), list(keys), "left")
    verdict = (
        F.when(F.col("coverage") < 0.70, F.lit("too narrow")).when(F.col("coverage") > 0.90, F.lit("conservative")).otherwise(F.lit("on target"))
    )
    return report.withColumn("verdict", verdict)


def skill_against(frame: DataFrame, baseline_id: str, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """MAE of every predictor beside the baseline's at the same key."""
    mae = frame.groupBy("predictor_id", *by).agg(F.avg("abs_error").alias("mae"))
    base = mae.filter(F.col("predictor_id") == baseline_id).select(*by, F.col("mae").alias("baseline_mae"))
    return mae.join(base, list(by), "left").withColumn("mae_gain", F.col("baseline_mae") - F.col("mae"))


def horizon_trends(report: DataFrame) -> DataFrame:
    """Verdicts from the first to the last horizon of an error report."""
    first, last = (lambda c: F.min_by(c, "horizon")), (lambda c: F.max_by(c, "horizon"))
    out = report.groupBy("predictor_id").agg(
        first("coverage").alias("_c0"), last("coverage").alias("_c1"), first("mae").alias("_m0"), last("mae").alias("_m1"),
        (F.bool_and(F.col("mean_bias") > 0) | F.bool_and(F.col("mean_bias") < 0)).alias("bias_consistent"),
    )
    coverage = F.when(F.col("_c1") < F.col("_c0") - 0.05, F.lit("worsens")).when(F.col("_c1") > F.col("_c0") + 0.05, F.lit("improves"))
    return out.select(
        "predictor_id", coverage.otherwise(F.lit("flat")).alias("coverage_trend"),
        F.when(F.col("_m1") > F.col("_m0") * 1.1, F.lit("increases")).otherwise(F.lit("flat")).alias("mae_trend"), "bias_consistent",
    )


# --- event panels, metadata, costs ------------------------------------------------------------


def metadata_long(df: DataFrame, keys: Sequence[str], column: str = "metadata") -> DataFrame:
    """Explode a JSON object column to ``key, value`` rows (keys differ per row; the union is the key set)."""
    return df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def metadata_wide(df: DataFrame, keys: Sequence[str], names: Sequence[str], column: str = "metadata") -> DataFrame:
    """``meta_<key>`` columns for known keys, null where a row lacks one."""
    m = F.from_json(column, "map<string,string>")
    return df.select(*keys, *[F.try_element_at(m, F.lit(n)).alias(f"meta_{n}") for n in names])


def event_panel(predictions: DataFrame, events: DataFrame, categories: Column) -> DataFrame:
    """Newest event of each series: every predictor's distribution, the outcome and the previous outcome."""

    outcomes = lags(events, ["series_id"], "timestamp", {"prior_value": ("value", 1)})
    newest = predictions.groupBy("series_id").agg(F.max("forecast_date").alias("forecast_date"))
    shown = predictions.join(newest, ["series_id", "forecast_date"], "left_semi")
    joined = shown.join(
        outcomes.select("series_id", F.col("timestamp").alias("forecast_date"), F.col("value").alias("outcome_value"), "prior_value"),
        ["series_id", "forecast_date"], "left",
    )
    return joined.withColumn("outcome_label", sc.category_label(categories, F.col("outcome_value"))).withColumn(
        "prior_outcome_label", sc.category_label(categories, F.col("prior_value"))
    )


def cost_latency(df: DataFrame) -> DataFrame:
    """Total cost, mean and worst latency per predictor; nulls are ignored."""
    return df.groupBy("predictor_id").agg(
        F.sum("cost_usd").alias("total_usd"), F.avg("cost_usd").alias("mean_usd"),
        F.avg("latency_s").alias("mean_latency_s"), F.max("latency_s").alias("max_latency_s"), F.count(F.lit(1)).alias("n"),
    )


def arm_summary(df: DataFrame) -> DataFrame:
    """Brier and mean probability before shocks and before calm sessions, per arm."""
    return df.groupBy("predictor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("outcome").cast("long").alias("shocks"),
        F.avg("score").alias("brier"),
        F.avg(F.when(F.col("outcome") == 1, F.col("probability"))).alias("p_before_shock"),
        F.avg(F.when(F.col("outcome") == 0, F.col("probability"))).alias("p_before_calm"),
    ).withColumn("separation", F.col("p_before_shock") - F.col("p_before_calm"))


def alignment_label(label_correct: Column, reasons_aligned: Column) -> Column:
    """Right-for-the-right-reasons two-by-two."""
    return F.concat_ws(
        "_", F.when(label_correct, F.lit("correct")).otherwise(F.lit("incorrect")),
        F.when(reasons_aligned, F.lit("aligned")).otherwise(F.lit("misaligned")),
    )


def alignment_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("predictor_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("alignment").alias("mean_alignment"),
        F.count_if(F.col("quadrant") == "correct_aligned").alias("n_right_right"),
    )


def gap_positions(origins: DataFrame, sessions: DataFrame, rows: int = 8) -> DataFrame:
    """Distance in business days from each origin's last visible session to the nearest missing one.

    Only the span of the last ``rows`` visible sessions is searched.  A missing day is a
    weekday without a session released by the origin: one released later is missing until then, and marks nothing itself.
    """
    seen = forecast.context(origins, sessions)
    found = _nearest_missing(seen, sessions, rows)
    return found.select(*origins.columns, "nearest_missing", "rows_from_end", "last_value")


@forecast.cut_first
def _nearest_missing(ctx: DataFrame, sessions: DataFrame, rows: int) -> DataFrame:
    """The newest missing day before each session is a running maximum, so no calendar is paired with the origins."""
    prev = lags(sessions, ["series_id"], "timestamp", {"_p": ("timestamp", 1)})
    before = cal.plus_days("timestamp", -1)
    newest_missing = F.when(cal.is_weekday(before), before).otherwise(cal.plus_days(before, F.lit(4) - F.weekday(before)))
    marked = prev.withColumn("_gap", F.when((F.col("_p") < newest_missing) & F.col("_p").isNotNull(), newest_missing))
    carried = running(marked, ["series_id"], "timestamp", {"_missing": ("max", F.col("_gap"))})
    spanned = lags(carried, ["series_id"], "timestamp", {"_from": ("timestamp", rows - 1)})
    found = asof.state_at(ctx, spanned, ["series_id"], "as_of", asof.released(), {"_s": asof.latest("value", "_missing", "_from")})
    missing = F.when(F.col("_s._missing") > F.coalesce("_s._from", F.lit("1900-01-01").cast("timestamp_ntz")), F.col("_s._missing"))
    return found.withColumn("nearest_missing", missing).withColumn(
        "rows_from_end", F.when(missing.isNotNull(), cal.business_days_between(missing, F.col("_s.at")))
    ).withColumn("last_value", F.col("_s.value")).drop("_s")


def term_structure(quotes: DataFrame) -> DataFrame:
    """Last quote per contract, then contango when the farthest contract trades above the nearest."""
    last = quotes.groupBy("series_id", "contract", "expiry").agg(F.max_by("close", "timestamp").alias("close"))
    curve = last.groupBy("series_id").agg(
        F.min_by("close", "expiry").alias("near"), F.max_by("close", "expiry").alias("far"), F.count(F.lit(1)).alias("n_contracts")
    )
    return curve.withColumn("contango", (F.col("n_contracts") > 1) & (F.col("far") > F.col("near")))
