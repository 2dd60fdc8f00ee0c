"""Closed-form statistics Spark SQL lacks, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_STIRLING_FROM = 32


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF by its power series, full double precision inside |x| < 8.

    Phi(x) = 1/2 + phi(x) * (x + x^3/3 + x^5/(3*5) + ...).
    """
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * x * x / (F.lit(2.0) * k + F.lit(1.0))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    terms = F.least(F.lit(120.0), F.abs(x) * 12 + 25).cast("int")  # enough for the last bit
    series = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda a: a["total"])
    inner = F.lit(0.5) + F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * series
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner))
    return F.when(x >= 8, F.lit(1.0)).when(x <= -8, F.lit(0.0)).otherwise(clamped)


def log_factorial(n: Column) -> Column:
    """ln(n!): an exact short sum below 32, Stirling's series (error < 1e-13) from there on."""
    x = n.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(_STIRLING_FROM)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda a, k: a + F.ln(k.cast("double")),
    )
    big = (
        x * F.ln(x) - x + F.ln(F.lit(2 * math.pi) * x) / 2
        + F.lit(1.0) / (12 * x) - F.lit(1.0) / (360 * x * x * x) + F.lit(1.0) / (1260 * x * x * x * x * x)
    )
    return F.when(n <= 1, F.lit(0.0)).when(n < _STIRLING_FROM, small).otherwise(big)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_greater(hits: Column, n_shocks: Column, n_controls: Column, n_matches: Column) -> Column:
    """One-sided Fisher exact p: at least ``hits`` shocks among ``n_matches`` matched windows.

    The first term of the hypergeometric tail comes from log factorials, the rest
    from the ratio of neighbouring terms.
    """
    first = F.greatest(hits, n_matches - n_controls).cast("long")
    last = F.least(n_shocks, n_matches).cast("long")
    t0 = F.exp(
        log_choose(n_shocks, first) + log_choose(n_controls, n_matches - first) - log_choose(n_shocks + n_controls, n_matches)
    )
    start = F.struct(t0.alias("term"), t0.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        ratio = ((n_shocks - k) * (n_matches - k)).cast("double") / ((k + 1) * (n_controls - n_matches + k + 1)).cast("double")
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, step, lambda a: a["total"])
    return F.when(first > last, F.lit(0.0)).otherwise(F.least(F.lit(1.0), tail))


def population_lift(sensitivity: Column, false_match_rate: Column, base_rate: Column) -> Column:
    """P(match | shock) / P(match), with P(match) rebuilt from the population's base rate."""
    matched = sensitivity * base_rate + false_match_rate * (F.lit(1.0) - base_rate)
    return F.when(matched > 0, sensitivity / matched)


def safe_ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    out = F.when(den != 0, num / den)
    return out if otherwise is None else out.otherwise(F.lit(otherwise))
