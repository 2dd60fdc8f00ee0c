"""Proper scores and forecast-payload checks as Column expressions.

A continuous payload is ``ARRAY<STRUCT<q, v>>``, a binary one a probability and a
categorical one ``MAP<label, probability>`` read in the task's category order.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

# The quantile levels every continuous forecast carries.
QUANTILE_LEVELS = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95)
Z_SCORES = {q: NormalDist().inv_cdf(q) for q in QUANTILE_LEVELS}

METRIC_OF_PAYLOAD = {"continuous": "crps", "binary": "brier", "categorical": "rps"}

MATCH_TOLERANCE = 1e-9
SUM_TOLERANCE = 1e-6
RENORMALISE_TOLERANCE = 0.05
EDGE = 1e-9  # a sum on the tolerance counts as within it, whatever the last bits of the addition


# --- building and reading quantile payloads ---------------------------------


def quantiles_of(value_at) -> Column:
    """Build a payload from a Python function ``level -> Column`` over the standard levels."""
    return F.array(*[F.struct(F.lit(q).alias("q"), value_at(q).cast("double").alias("v")) for q in QUANTILE_LEVELS])


def point_mass(value: Column) -> Column:
    return quantiles_of(lambda _: value)


def quantiles_from_array(values: Column) -> Column:
    """Payload from an array already ordered by the standard levels (e.g. ``percentile(x, levels)``)."""
    return quantiles_of(lambda q: F.element_at(values, QUANTILE_LEVELS.index(q) + 1))


def quantile_at(quantiles: Column, level: float) -> Column:
    """Value at one level, matched with a tolerance so 0.1 and 0.10 stored as text both hit."""
    hits = F.filter(quantiles, lambda s: F.abs(s["q"] - F.lit(level)) <= MATCH_TOLERANCE)
    return F.try_element_at(hits, F.lit(1))["v"]


def central_interval(quantiles: Column, coverage: float) -> Column:
    """Central interval as ``STRUCT<lo, hi>``: 0.80 reads q10-q90, 0.90 reads q05-q95."""
    tail = (1.0 - coverage) / 2.0
    return F.struct(
        quantile_at(quantiles, round(tail, 6)).alias("lo"), quantile_at(quantiles, round(1 - tail, 6)).alias("hi")
    )


def quantile_values(quantiles: Column) -> Column:
    return F.transform(quantiles, lambda s: s["v"])


def monotone(quantiles: Column) -> Column:
    """Rearrange crossed quantiles: sorted values on sorted levels."""
    levels = F.array_sort(F.transform(quantiles, lambda s: s["q"]))
    values = F.array_sort(quantile_values(quantiles))
    return F.zip_with(levels, values, lambda q, v: F.struct(q.alias("q"), v.alias("v")))


def prob_above(quantiles: Column, threshold: Column | float) -> Column:
    """``P(X > threshold)`` from the piecewise-linear CDF through the quantile pairs, ends clamped."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pairs = F.array_sort(F.transform(quantiles, lambda s: F.struct(s["v"].alias("v"), s["q"].alias("q"))))
    at_or_below = F.filter(pairs, lambda s: s["v"] <= t)
    lo = F.try_element_at(at_or_below, F.lit(-1))
    hi = F.try_element_at(F.filter(pairs, lambda s: s["v"] > t), F.lit(1))
    cdf = (
        F.when(lo.isNull(), F.lit(0.0))
        .when(hi.isNull(), F.when(lo["v"] == t, lo["q"]).otherwise(F.lit(1.0)))
        .otherwise(lo["q"] + (hi["q"] - lo["q"]) / (hi["v"] - lo["v"]) * (t - lo["v"]))
    )
    return F.when(F.size(quantiles) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - cdf)))


def gaussian_quantiles(mean: Column, sigma: Column) -> Column:
    return quantiles_of(lambda q: mean + sigma * F.lit(Z_SCORES[q]))


def sigma_from_band(lower: Column, upper: Column, z: float = 1.96) -> Column:
    """Standard deviation of a Gaussian whose central band is ``[lower, upper]``."""
    return (upper - lower) / F.lit(2 * z)


# --- scores -------------------------------------------------------------------


def crps(quantiles: Column, actual: Column) -> Column:
    """CRPS of the quantile values read as an equal-weight ensemble (levels ignored, 1/m^2 form).

    With sorted members the pair term needs one pass: sum (2i + 1 - m) x_i / m^2.
    """
    x = F.array_sort(quantile_values(quantiles))
    m = F.size(x).cast("double")
    zero = F.lit(0.0)
    distance = F.aggregate(x, zero, lambda a, v: a + F.abs(v - actual)) / m
    weighted = F.transform(x, lambda v, i: (F.lit(2.0) * i + F.lit(1.0) - m) * v)
    return F.when(F.size(x) > 0, distance - F.aggregate(weighted, zero, lambda a, v: a + v) / (m * m))


def brier(probability: Column, actual: Column) -> Column:
    d = probability - actual
    checked = F.when(actual.isin(0.0, 1.0), d * d)
    return F.when(actual.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(checked, F.raise_error(F.lit("a Brier outcome must be 0 or 1")).cast("double"))
    )


def ordered_probabilities(probs: Column, categories: Column) -> Column:
    return F.transform(categories, lambda c: F.try_element_at(probs, c["label"]))


def same_value(a: Column, b: Column) -> Column:
    """Equality within 1e-9, absolute or relative."""
    bound = F.greatest(F.lit(MATCH_TOLERANCE), F.lit(MATCH_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)))
    return F.abs(a - b) <= bound


def category_index(categories: Column, actual: Column) -> Column:
    """Zero-based position of the category whose value equals ``actual``; null when none does."""
    hits = F.filter(
        F.transform(categories, lambda c, i: F.when(same_value(c["value"], actual), i)), lambda i: i.isNotNull()
    )
    return F.try_element_at(hits, F.lit(1))


def category_label(categories: Column, actual: Column) -> Column:
    return F.try_element_at(F.filter(categories, lambda c: same_value(c["value"], actual)), F.lit(1))["label"]


def rps(probabilities: Column, outcome_index: Column) -> Column:
    """Ranked probability score over ordered categories, not divided by K - 1 (equals Brier for K = 2)."""
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("total"))
    steps = F.transform(
        F.slice(probabilities, F.lit(1), F.size(probabilities) - 1),
        lambda p, k: F.struct(p.alias("p"), F.when(outcome_index <= k, F.lit(1.0)).otherwise(F.lit(0.0)).alias("o")),
    )

    def fold(acc: Column, s: Column) -> Column:
        cum = acc["cum"] + s["p"]
        gap = cum - s["o"]
        return F.struct(cum.alias("cum"), (acc["total"] + gap * gap).alias("total"))

    return F.when(
        outcome_index.isNotNull() & (F.size(probabilities) >= 2), F.aggregate(steps, start, fold, lambda a: a["total"])
    )


def score(actual: Column) -> Column:
    """The payload's own metric, for rows of the predictions schema carrying ``categories``."""
    categorical = rps(ordered_probabilities(F.col("probs"), F.col("categories")), category_index(F.col("categories"), actual))
    return (
        F.when(F.col("payload_type") == "continuous", crps(F.col("quantiles"), actual))
        .when(F.col("payload_type") == "binary", brier(F.col("probability"), actual))
        .when(F.col("payload_type") == "categorical", categorical)
    )


def metric_name(payload_type: Column) -> Column:
    out = None
    for payload, metric in METRIC_OF_PAYLOAD.items():
        out = (out if out is not None else F).when(payload_type == payload, F.lit(metric))
    return out


# --- contract checks: each returns an array of violated rules, empty when valid --


def _rules(*named: tuple[str, Column]) -> Column:
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in named]
    return F.array_compact(F.array(*broken))


def quantile_key_issues(quantiles: Column) -> Column:
    return _rules(("levels_in_open_unit_interval", F.forall(quantiles, lambda s: (s["q"] > 0) & (s["q"] < 1))))


def quantile_grid_issues(quantiles: Column, point: Column) -> Column:
    """The agent-output contract: the standard grid, once each, non-decreasing, median equal to the point."""
    q = F.transform(quantiles, lambda s: F.round(s["q"], 9))
    grid = F.array(*[F.lit(float(v)) for v in QUANTILE_LEVELS])
    by_level = F.transform(F.array_sort(quantiles), lambda s: s["v"])
    n = F.size(by_level)
    steps = F.zip_with(F.slice(by_level, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(by_level, 2, n), lambda a, b: a <= b)
    median = quantile_at(quantiles, 0.5)
    return _rules(
        ("point_finite", point.isNotNull() & ~F.isnan(point) & (F.abs(point) < float("inf"))),
        ("no_duplicate_levels", F.size(F.array_distinct(q)) == F.size(q)),
        ("no_missing_levels", F.size(F.array_except(grid, q)) == 0),
        ("no_extra_levels", F.size(F.array_except(q, grid)) == 0),
        ("non_decreasing", F.forall(steps, lambda ok: ok)),
        ("point_is_median", same_value(point, median)),
    )


def probability_issues(probability: Column) -> Column:
    return _rules(
        ("finite", probability.isNotNull() & ~F.isnan(probability)), ("in_unit_interval", probability.between(0.0, 1.0))
    )


def distribution_issues(probs: Column) -> Column:
    p = F.map_values(probs)
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return _rules(
        ("at_least_two", F.size(p) >= 2),
        ("each_in_unit_interval", F.forall(p, lambda v: v.between(0.0, 1.0))),
        ("sums_to_one", F.abs(total - 1.0) <= SUM_TOLERANCE),
    )


def label_issues(probs: Column, categories: Column) -> Column:
    have, want = F.map_keys(probs), F.transform(categories, lambda c: c["label"])
    return _rules(
        ("no_missing_labels", F.size(F.array_except(want, have)) == 0),
        ("no_extra_labels", F.size(F.array_except(have, want)) == 0),
    )


def category_issues(categories: Column) -> Column:
    labels, values = F.transform(categories, lambda c: c["label"]), F.transform(categories, lambda c: c["value"])
    return _rules(
        ("at_least_two", F.size(categories) >= 2),
        ("labels_unique", F.size(F.array_distinct(labels)) == F.size(labels)),
        ("values_unique", F.size(F.array_distinct(values)) == F.size(values)),
    )


def spec_issues() -> Column:
    inside = F.forall("origin_dates", lambda d: (d >= F.col("start")) & (d <= F.col("end")))
    return _rules(
        ("start_before_end", F.col("start") < F.col("end")),
        ("stride_positive", F.col("stride") >= 1),
        ("origins_inside_window", F.when(F.col("origin_dates").isNull(), F.lit(True)).otherwise(inside)),
    )


def renormalised(probs: Column) -> Column:
    """Divide by the sum when it is positive and within 5 % of one; null (rejected) otherwise."""
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, v: a + v)
    ok = (total > 0) & (F.abs(total - 1.0) <= RENORMALISE_TOLERANCE + EDGE)
    return F.when(ok, F.transform_values(probs, lambda _, v: v / total))


def argmax_label(probs: Column, categories: Column) -> Column:
    """The likeliest label; the earliest category wins a tie."""
    ranked = F.transform(
        categories,
        lambda c, i: F.struct(F.try_element_at(probs, c["label"]).alias("p"), (-i).alias("rank"), c["label"].alias("label")),
    )
    return F.array_max(ranked)["label"]


def one_vs_rest(df: DataFrame, categories: Column) -> DataFrame:
    """Every category's binary view at once: ``label, probability, outcome`` (null outcome = unresolved)."""
    out = df.withColumn("_c", F.explode(categories))
    return (
        out.withColumn("label", F.col("_c.label"))
        .withColumn("probability", F.try_element_at("probs", F.col("_c.label")))
        .withColumn("outcome", F.when(F.col("outcome_label").isNotNull(), (F.col("outcome_label") == F.col("_c.label")).cast("double")))
        .drop("_c")
    )
