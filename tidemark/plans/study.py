"""Event-study plans: the study set, and every candidate scored and gated in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import events as ev


def study_set(
    days: DataFrame, threshold_pct: float, holdout_start: str, holdout_end: str, *, n_each: int = 1,
    holdout_controls: int = 1, seed: int = ev.SEED,
) -> DataFrame:
    """Shock windows and matched controls with their split.

    With more than one holdout control per shock, holdout controls are drawn again for
    the holdout's shocks alone and must lie wholly inside the holdout.
    """
    shocks = ev.shock_windows(days, threshold_pct)
    pool = ev.control_candidates(days, shocks, threshold_pct, holdout_start, holdout_end)
    controls = ev.matched_controls(days, pool, n_each, seed)
    windows = ev.train_holdout(shocks.unionByName(controls), holdout_start, holdout_end).filter(F.col("split").isNotNull())
    if holdout_controls == 1:
        return windows
    held = windows.filter((F.col("split") == "holdout") & F.col("is_shock"))
    pool = ev.control_candidates(days, held.drop("split"), threshold_pct, holdout_start, holdout_end)
    extra = ev.train_holdout(ev.matched_controls(days, pool, holdout_controls, seed), holdout_start, holdout_end)
    return windows.filter((F.col("split") == "train") | F.col("is_shock")).unionByName(extra.filter(F.col("split") == "holdout"))


def population_holdout(days: DataFrame, windows: DataFrame, threshold_pct: float, holdout_start: str, holdout_end: str) -> DataFrame:
    """The study set with its holdout replaced by every session of the holdout period."""
    whole = ev.train_holdout(ev.population_windows(days, threshold_pct), holdout_start, holdout_end)
    return windows.filter(F.col("split") == "train").unionByName(whole.filter(F.col("split") == "holdout"))


def evaluate_candidates(
    windows: DataFrame, rules: dict[str, ev.Rule], bases: DataFrame, directions: dict[str, str] | None = None, *, bootstrap: bool = True
) -> DataFrame:
    """Evidence on both splits and the gate's verdict for every rule at once."""
    matches = ev.apply_rules(windows, rules)
    metrics = ev.pattern_metrics(ev.evidence_counts(matches, directions), bases, bootstrap=bootstrap)
    return verdicts(metrics)


def verdicts(metrics: DataFrame) -> DataFrame:
    wide = ev.side_by_side(metrics)
    if "train_ci_low" not in wide.columns:
        wide = wide.withColumn("train_ci_low", F.lit(None).cast("double"))
    return wide.withColumn("reasons", ev.gate_reasons()).withColumn("graduates", F.size("reasons") == 0).withColumn("why_not", ev.failure_group())


def screen_then_test(holdout: DataFrame, train: DataFrame, bases: DataFrame) -> DataFrame:
    """Two stages on stored labels: patterns failing the holdout screen never touch their training windows.

    Every pattern comes back with its ``stage``; screened-out ones carry no train evidence.
    """
    held = ev.side_by_side(ev.pattern_metrics(ev.evidence_counts(holdout), bases, bootstrap=False)).select(
        "series_id", "pattern_id", ev.holdout_passes().alias("_pass")
    )
    survivors = held.filter("_pass").select("series_id", "pattern_id")
    both = train.join(survivors, ["series_id", "pattern_id"], "left_semi").unionByName(
        holdout.join(survivors, ["series_id", "pattern_id"], "left_semi")
    )
    tested = verdicts(ev.pattern_metrics(ev.evidence_counts(both), bases))
    stage = F.when(F.col("_pass"), F.lit("tested on train")).otherwise(F.lit("screened out on the holdout"))
    return (
        held.withColumn("stage", stage)
        .join(tested, ["series_id", "pattern_id"], "left")
        .withColumn("graduates", F.coalesce("graduates", F.lit(False)))
        .drop("_pass")
    )


def rationale_alignment(predictions: DataFrame, documents: DataFrame, outcomes: DataFrame, categories: Column) -> DataFrame:
    """Forecast, document and outcome side by side; events without a document are skipped.

    ``predictions`` carries ``alignment`` (a stored verdict in [0, 1]).
    """
    from tidemark.functions import scoring as sc
    from tidemark.operators.analysis import alignment_label

    seen = documents.select("series_id", F.col("publication_date").alias("_day"), "doc_id")
    real = outcomes.select("series_id", F.col("timestamp").alias("forecast_date"), F.col("value").alias("actual"))
    joined = predictions.withColumn("_day", F.to_date("forecast_date")).join(seen, ["series_id", "_day"]).join(real, ["series_id", "forecast_date"], "left")
    predicted = sc.argmax_label(F.col("probs"), categories)
    correct = predicted == sc.category_label(categories, F.col("actual"))
    return joined.drop("_day").withColumn("predicted", predicted).withColumn(
        "quadrant", alignment_label(F.coalesce(correct, F.lit(False)), F.col("alignment") >= 0.5)
    )
