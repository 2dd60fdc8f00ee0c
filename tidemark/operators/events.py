"""Event studies: shocks, matched controls, pattern evidence and the graduation gate.

Works on *sessions*: one row per series and trading day.  :func:`sessions` enforces that
grain first with a partial aggregate, so a series holds at most one row per calendar day
(about 26k a century) whatever the raw row counts were.  That bound is why ordinary
per-series windows are used here instead of the blocked ones of
:mod:`tidemark.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions import calendar as cal
from tidemark.functions.stats import fisher_greater, population_lift
from tidemark.functions.text import fixed_text
from tidemark.operators import asof
from tidemark.operators.bootstrap import RESAMPLES, paired_bootstrap
from tidemark.operators.ordered import expanding_percentiles, row_index
from tidemark.session import settled

KEY = ["series_id"]


def _in_order():
    return Window.partitionBy(*KEY).orderBy("timestamp")


VOL_SESSIONS = 21
REGIME_HISTORY = 252
CLUSTER_GAP = 1
CONTROL_REACH = 126
CONTROL_ZONE = 2
POOL_MULTIPLE = 5
SEED = 0


def sessions(prices: DataFrame) -> DataFrame:
    """One close per series and day with its position, percent return and volatilities.

    ``vol`` is the deviation of the last 21 returns including the day's, ``vol_before``
    the one known before the day.
    """
    daily = prices.groupBy("series_id", cal.midnight("timestamp").alias("timestamp")).agg(
        F.max_by("value", "timestamp").alias("value")
    )
    w = _in_order()

    def sd(lo: int, hi: int) -> Column:
        frame = w.rowsBetween(lo, hi)
        return F.when(F.count("return_pct").over(frame) == VOL_SESSIONS, F.stddev_samp("return_pct").over(frame))

    returns = daily.withColumn("return_pct", (F.col("value") / F.lag("value").over(w) - 1) * 100)
    return returns.withColumns(
        {"vol": sd(1 - VOL_SESSIONS, 0), "vol_before": sd(-VOL_SESSIONS, -1), "idx": F.row_number().over(w).cast("long")}
    )


def is_shock(threshold_pct: float, column: str = "return_pct") -> Column:
    return F.coalesce(F.abs(F.col(column)) >= threshold_pct, F.lit(False))


def direction_of(column: str = "return_pct") -> Column:
    return F.when(F.col(column) > 0, F.lit("up")).otherwise(F.lit("down"))


def shock_windows(days: DataFrame, threshold_pct: float, horizon: int = 1) -> DataFrame:
    """Independent shock events: runs of shock sessions at most ``1 + horizon - 1`` sessions apart.

    A window is anchored on its largest move (earliest on a tie) and its ``as_of`` is the
    session ``horizon`` before the run's first shock.
    """
    moved = days
    if horizon != 1:
        moved = days.withColumn("return_pct", (F.col("value") / F.lag("value", horizon).over(_in_order()) - 1) * 100)
    shocks = moved.filter(is_shock(threshold_pct)).select(*KEY, "timestamp", "idx", "return_pct")
    gaps = shocks.withColumn("_prev", F.lag("idx").over(_in_order()))
    opens = F.when(F.col("_prev").isNull() | (F.col("idx") - F.col("_prev") > CLUSTER_GAP + horizon - 1), F.lit(1)).otherwise(F.lit(0))
    runs = gaps.withColumn("_run", F.sum(opens).over(_in_order()))
    events = runs.groupBy(*KEY, "_run").agg(
        F.min("idx").alias("_first"),
        F.max(F.struct(F.abs("return_pct"), (-F.col("idx")).alias("i"), "timestamp", "return_pct")).alias("_top"),
    )
    start = days.select(*KEY, F.col("idx").alias("_first_as_of"), F.col("timestamp").alias("as_of"))
    return (
        events.withColumn("_first_as_of", F.col("_first") - horizon)
        .join(start, [*KEY, "_first_as_of"])
        .select(
            *KEY, "as_of", F.col("_top.timestamp").alias("event_date"), F.lit(True).alias("is_shock"),
            F.col("_top.return_pct").alias("return_pct"), F.col("_first_as_of").alias("as_of_idx"), (-F.col("_top.i")).alias("event_idx"),
        )
        .withColumn("direction", direction_of())
    )


def split_period(day: Column, holdout_start: str, holdout_end: str) -> Column:
    """0 before the holdout, 1 inside it, 2 after it."""
    return F.when(day < F.lit(holdout_start).cast("timestamp_ntz"), 0).when(day <= F.lit(holdout_end).cast("timestamp_ntz"), 1).otherwise(2)


def straddles(days: DataFrame) -> DataFrame:
    """Flag sessions whose previous session lies in another period (and each series' first)."""
    prev = days.withColumn("_p", F.lag("period").over(_in_order()))
    return prev.withColumn("straddles", F.col("_p").isNull() | (F.col("_p") != F.col("period"))).drop("_p")


def control_candidates(days: DataFrame, windows: DataFrame, threshold_pct: float, holdout_start: str, holdout_end: str) -> DataFrame:
    """Every eligible control of every shock window, with its volatility distance.

    Each shock asks for the 2 x 126 sessions around it by position, an equi-join; sessions
    near any shock or window, at a period boundary, or without a trailing volatility are out.
    """
    dated = straddles(days.withColumn("period", split_period(F.col("timestamp"), holdout_start, holdout_end)))
    zone = lambda lo, hi: F.explode(F.sequence(lo - CONTROL_ZONE, hi + CONTROL_ZONE)).alias("idx")
    near = days.filter(is_shock(threshold_pct)).select(*KEY, zone(F.col("idx"), F.col("idx"))).unionByName(
        windows.select(*KEY, zone(F.col("as_of_idx"), F.col("event_idx")))
    )
    eligible = dated.filter(F.col("vol_before").isNotNull() & ~F.col("straddles")).join(near.distinct(), [*KEY, "idx"], "left_anti")
    target = dated.select(*KEY, F.col("idx").alias("_after"), F.col("vol_before").alias("target_vol"))
    asked = (
        windows.withColumn("_after", F.col("as_of_idx") + 1)
        .join(target, [*KEY, "_after"], "left")
        .join(dated.select(*KEY, F.col("idx").alias("event_idx"), F.col("period").alias("shock_period")), [*KEY, "event_idx"])
        .select(
            *KEY, F.col("event_date").alias("shock_date"), "target_vol", "shock_period",
            F.explode(F.sequence(F.greatest(F.col("event_idx") - CONTROL_REACH, F.lit(1).cast("long")), F.col("event_idx") + CONTROL_REACH)).alias("idx"),
        )
    )
    return (
        asked.join(eligible, [*KEY, "idx"])
        .filter(F.col("period") == F.col("shock_period"))
        .withColumn("distance", F.abs(F.col("vol_before") - F.col("target_vol")))
        .select(*KEY, "shock_date", "idx", F.col("timestamp").alias("event_date"), "return_pct", "distance", "period")
    )


def nearest_candidates(candidates: DataFrame, n_each: int = 1) -> DataFrame:
    """The ``5 n`` candidates of each shock closest in volatility."""
    closest = Window.partitionBy(*KEY, "shock_date").orderBy(F.col("distance").asc_nulls_last(), "event_date")
    return candidates.withColumn("rank", F.row_number().over(closest)).filter(F.col("rank") <= POOL_MULTIPLE * n_each)


def draw_controls(candidates: DataFrame, n_each: int = 1, seed: int = SEED) -> DataFrame:
    """``n_each`` controls per shock without replacement, by rounds of proposals.

    In a round every shock that is still short proposes to as many as it needs of the ``5 n`` free candidates closest in
    volatility, those of smallest hash; a control wanted by several goes to the shock of smallest hash.  Rounds end when no
    shock is short or has a free candidate, so the cost follows the contests, and a shock's rows (at most 253) are all that
    meets in one place.  Where no free candidate has a distance, all of them are in reach.
    """
    told = lambda *more: F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id", F.date_format("shock_date", "yyyy-MM-dd HH:mm:ss"), *more))
    rows = candidates.select(*KEY, "shock_date", "idx", "event_date", "return_pct", "distance")
    ranked = rows.withColumns({"turn": told(), "ticket": told(F.col("idx").cast("string")), "need": F.lit(n_each).cast("long")})
    free = settled(ranked, "candidates")
    shock, control = [*KEY, "shock_date"], [*KEY, "idx"]
    closest = Window.partitionBy(*shock).orderBy(F.col("distance").asc_nulls_last(), "idx")
    parts = []
    while not free.isEmpty():
        pool = free.withColumn("_near", F.row_number().over(closest)).withColumn("_any", F.max("distance").over(Window.partitionBy(*shock)))
        pool = pool.filter((F.col("_near") <= POOL_MULTIPLE * n_each) | F.col("_any").isNull())
        asked = pool.withColumn("_ask", F.row_number().over(Window.partitionBy(*shock).orderBy("ticket", "idx"))).filter(F.col("_ask") <= F.col("need"))
        won = asked.withColumn("_won", F.row_number().over(Window.partitionBy(*control).orderBy("turn", "shock_date"))).filter("_won = 1")
        won = settled(won.select(*KEY, "idx", "event_date", "return_pct", "shock_date"), "drawn")
        parts.append(won)
        got = won.groupBy(*shock).agg(F.count(F.lit(1)).alias("_got"))
        left = free.join(won.select(*control), control, "left_anti").join(got, shock, "left")
        free = settled(left.withColumn("need", F.col("need") - F.coalesce("_got", F.lit(0))).filter("need > 0").drop("_got"), "candidates")
    drawn = rows.select(*KEY, "idx", "event_date", "return_pct", "shock_date").limit(0)
    for part in parts:
        drawn = drawn.unionByName(part)
    return drawn


def control_windows(days: DataFrame, drawn: DataFrame) -> DataFrame:
    """Drawn controls as windows that open at the session before them."""
    previous = days.select(*KEY, (F.col("idx") + 1).alias("idx"), F.col("timestamp").alias("as_of"))
    return drawn.join(previous, [*KEY, "idx"]).select(
        *KEY, "as_of", "event_date", F.lit(False).alias("is_shock"), "return_pct",
        (F.col("idx") - 1).alias("as_of_idx"), F.col("idx").alias("event_idx"), F.lit(None).cast("string").alias("direction"),
    )


def matched_controls(days: DataFrame, candidates: DataFrame, n_each: int = 1, seed: int = SEED) -> DataFrame:
    """Controls drawn without replacement for every shock, as windows."""
    return control_windows(days, draw_controls(candidates, n_each, seed))


def control_shortage(windows: DataFrame, drawn: DataFrame, n_each: int = 1) -> DataFrame:
    """Per series: shocks, how many of them got fewer than ``n_each`` controls, and how many controls are missing in all."""
    got = drawn.groupBy(*KEY, "shock_date").agg(F.count(F.lit(1)).alias("_got"))
    each = windows.select(*KEY, F.col("event_date").alias("shock_date")).join(got, [*KEY, "shock_date"], "left")
    missing = F.lit(n_each) - F.coalesce("_got", F.lit(0))
    return each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_shocks"), F.count_if(missing > 0).alias("n_short"), F.sum(missing).alias("n_missing"))


def train_holdout(windows: DataFrame, holdout_start: str, holdout_end: str) -> DataFrame:
    """Add ``split``: train before the holdout by event date; holdout only when as_of *and* event lie inside."""
    lo, hi = F.lit(holdout_start).cast("timestamp_ntz"), F.lit(holdout_end).cast("timestamp_ntz")
    split = F.when(F.col("event_date") < lo, F.lit("train")).when((F.col("as_of") >= lo) & (F.col("event_date") <= hi), F.lit("holdout"))
    return windows.withColumn("split", split)


def small_splits(windows: DataFrame, min_shocks: int) -> DataFrame:
    """Splits with too few shocks for their lift to mean anything."""
    return windows.filter(F.col("split").isNotNull()).groupBy(*KEY, "split").agg(F.count_if("is_shock").alias("n_shocks")).filter(F.col("n_shocks") < min_shocks)


def population_windows(days: DataFrame, threshold_pct: float) -> DataFrame:
    """Every session as a window whose event is the next session."""
    w = _in_order()
    nxt = days.withColumns({"event_date": F.lead("timestamp").over(w), "_move": F.lead("return_pct").over(w)})
    shock = F.coalesce(F.abs("_move") >= threshold_pct, F.lit(False))
    return nxt.filter(F.col("event_date").isNotNull()).select(
        *KEY, F.col("timestamp").alias("as_of"), "event_date", shock.alias("is_shock"), F.col("_move").alias("return_pct"),
        F.col("idx").alias("as_of_idx"), (F.col("idx") + 1).alias("event_idx"), F.when(shock, direction_of("_move")).alias("direction"),
    )


def base_rates(days: DataFrame, threshold_pct: float, split: Column) -> DataFrame:
    """Share of sessions that were shocks, per split and direction (either, up, down).

    A session without a return counts as a non-shock.
    """
    hit, r = is_shock(threshold_pct), F.col("return_pct")
    each = F.explode(
        F.array(
            F.struct(F.lit("either").alias("direction"), hit.alias("hit")),
            F.struct(F.lit("up").alias("direction"), (hit & (r > 0)).alias("hit")),
            F.struct(F.lit("down").alias("direction"), (hit & (r < 0)).alias("hit")),
        )
    )
    long = days.withColumn("split", split).filter(F.col("split").isNotNull()).select(*KEY, "split", each.alias("_d"))
    return long.groupBy(*KEY, "split", F.col("_d.direction").alias("direction")).agg(
        F.avg(F.coalesce(F.col("_d.hit"), F.lit(False)).cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n_sessions")
    )


def volatility_regimes(days: DataFrame, low: float = 0.33, high: float = 0.67, min_history: int = REGIME_HISTORY) -> DataFrame:
    """Low / normal / high against expanding quantiles of the volatility seen so far.

    A session without a volatility, or before ``min_history`` of them, has no cuts and no regime.
    """
    cuts = expanding_percentiles(days, KEY, "timestamp", "vol", {"low_cut": low, "high_cut": high}, min_history=min_history)
    cut = days.select("series_id", "timestamp", "vol").join(cuts, ["series_id", "timestamp"], "left")
    ok = F.col("vol").isNotNull() & ~F.isnan("vol") & F.col("low_cut").isNotNull() & ~F.isnan("low_cut")
    regime = F.when(F.col("vol") < F.col("low_cut"), F.lit("low")).when(F.col("vol") > F.col("high_cut"), F.lit("high")).otherwise(F.lit("normal"))
    return cut.withColumn("regime", F.when(ok, regime))


def regime_before(origins: DataFrame, regimes: DataFrame, days_back: int = 1) -> DataFrame:
    """Regime of the last session at least ``days_back`` days before each origin."""
    probes = origins.withColumn("_at", cal.plus_days(cal.midnight("as_of"), -days_back))
    found = asof.state_at(probes, regimes, KEY, "_at", F.col("timestamp"), {"_g": ("max", F.struct(F.col("timestamp").alias("at"), "regime"))})
    return found.withColumn("regime", F.col("_g.regime")).drop("_at", "_g")


# --- rules and evidence ----------------------------------------------------------------------

Rule = Callable[[DataFrame], Column]


def calendar_rule(flag: str) -> Rule:
    """A window matches when its ``as_of`` day carries a calendar flag column."""
    return lambda windows: F.coalesce(F.col(flag), F.lit(False))


def regime_rule(regime: str) -> Rule:
    return lambda windows: F.coalesce(F.col("regime") == regime, F.lit(False))


BUILTIN_RULES: dict[str, Rule] = {
    "announcement_after_close": calendar_rule("announced"),
    "high_volatility_regime": regime_rule("high"),
    "low_volatility_regime": regime_rule("low"),
}


def apply_rules(windows: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """One row per window and rule with its ``match``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pattern_id"), r(windows).alias("match")) for n, r in rules.items()]))
    out = windows.withColumn("_r", each)
    return out.withColumn("pattern_id", F.col("_r.pattern_id")).withColumn("match", F.col("_r.match")).drop("_r")


def label_rule_matches(windows: DataFrame, labels: DataFrame, on: Sequence[str] = ("day",)) -> DataFrame:
    """Matches from stored yes/no labels keyed by day (and more on request); a missing label is flagged, never assumed."""
    return windows.withColumn("day", F.to_date("as_of")).join(labels, list(on), "left").withColumn(
        "match", F.col("answer") == "yes"
    ).withColumn("label_missing", F.col("answer").isNull())


def evidence_counts(matches: DataFrame, directions: dict[str, str] | None = None) -> DataFrame:
    """Contingency counts per series, pattern and split, all patterns in one aggregate.

    For a one-directional pattern, shocks the other way count as non-shocks.
    """
    want = F.lit("either")
    for pattern, d in (directions or {}).items():
        want = F.when(F.col("pattern_id") == pattern, F.lit(d)).otherwise(want)
    df = matches.withColumn("direction_wanted", want)
    shock = F.col("is_shock") & ((F.col("direction_wanted") == "either") | F.coalesce(F.col("direction") == F.col("direction_wanted"), F.lit(False)))
    return df.withColumn("_s", shock).groupBy(*KEY, "pattern_id", "split", "direction_wanted").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if("match").alias("n_matches"),
        F.count_if(F.col("match") & F.col("_s")).alias("n_hits"),
        F.count_if("_s").alias("n_shocks"),
    ).withColumn("n_controls", F.col("n_windows") - F.col("n_shocks"))


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def lift_interval(hits: pd.Series, shocks: pd.Series, false: pd.Series, controls: pd.Series, base: pd.Series) -> pd.DataFrame:
    """95 % bootstrap interval of population lift, shocks and controls resampled separately.

    A resampled match count of n windows with k matches is Binomial(n, k/n), so the counts
    are drawn directly and cost does not grow with the windows.  Fixed seed per row.
    """
    out = np.full((len(hits), 2), np.nan)
    for i, (h, s, f, c, b) in enumerate(zip(hits, shocks, false, controls, base)):
        if not (s > 0 and c > 0):
            continue
        rng = np.random.default_rng(SEED)
        sens = rng.binomial(int(s), h / s, RESAMPLES) / s
        matched = sens * b + rng.binomial(int(c), f / c, RESAMPLES) / c * (1 - b)
        ok = matched > 0
        if ok.any():
            out[i] = np.percentile(sens[ok] / matched[ok], [2.5, 97.5])
    return pd.DataFrame(out, columns=["lo", "hi"])


def pattern_metrics(counts: DataFrame, bases: DataFrame, *, bootstrap: bool = True) -> DataFrame:
    """Lift, precision, exact p and lift interval from counts and population base rates."""
    rates = bases.select(*KEY, "split", F.col("direction").alias("direction_wanted"), "base_rate")
    df = counts.join(rates, [*KEY, "split", "direction_wanted"])
    h, s, c, m = (F.col(x) for x in ("n_hits", "n_shocks", "n_controls", "n_matches"))
    usable = (s > 0) & (c > 0)
    lift = F.when(usable, population_lift(h / s, (m - h) / c, F.col("base_rate")))
    out = df.withColumn("lift", lift).withColumn("precision", F.col("lift") * F.col("base_rate")).withColumn(
        "p_value", F.when(usable, F.when(m == 0, F.lit(1.0)).otherwise(fisher_greater(h, s, c, m)))
    )
    if not bootstrap:
        return out
    band = lift_interval(h.cast("double"), s.cast("double"), (m - h).cast("double"), c.cast("double"), F.col("base_rate"))
    clean = lambda x: F.when(~F.isnan(x), x)
    return out.withColumn("_ci", band).withColumn("ci_low", clean(F.col("_ci.lo"))).withColumn("ci_high", clean(F.col("_ci.hi"))).drop("_ci")


# Fixed values of the two gates.
GATE = {"min_matches": 5, "min_lift": 2.0, "max_p": 0.05, "min_ci_low": 1.0, "min_holdout_lift": 1.5, "max_holdout_p": 0.10}
EXPLORATORY_GATE = {"min_matches": 5, "min_lift": 1.5, "max_p": 0.10, "min_holdout_lift": 1.0}


def side_by_side(metrics: DataFrame) -> DataFrame:
    """One row per pattern with its train and holdout metrics (one conditional aggregate)."""
    names = [c for c in ("n_matches", "n_hits", "lift", "p_value", "ci_low", "precision") if c in metrics.columns]
    pick = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c))).alias(f"{split}_{c}")
    return metrics.groupBy(*KEY, "pattern_id").agg(*[pick(s, c) for s in ("train", "holdout") for c in names])


def _fails(name: str, passes: Column) -> Column:
    """The criterion's name unless it clearly passes: null (undefined) fails."""
    return F.when(~F.coalesce(passes, F.lit(False)), F.lit(name))


def gate_reasons(g: dict[str, float] = GATE) -> Column:
    """Array of failed criteria over a :func:`side_by_side` row; empty means the pattern graduates."""
    t, h = (lambda c: F.col(f"train_{c}")), (lambda c: F.col(f"holdout_{c}"))
    tested = F.coalesce(h("n_matches"), F.lit(0)) > 0
    return F.array_compact(
        F.array(
            _fails("train_matches", t("n_matches") >= g["min_matches"]),
            _fails("train_lift", t("lift") >= g["min_lift"]),
            _fails("train_p_value", t("p_value") < g["max_p"]),
            _fails("train_interval", t("ci_low") > g["min_ci_low"]),
            F.when(~tested, F.lit("holdout_untested")),
            F.when(tested, _fails("holdout_lift", h("lift") >= g["min_holdout_lift"])),
            F.when(tested, _fails("holdout_p_value", h("p_value") < g["max_holdout_p"])),
        )
    )


def exploratory_reasons(g: dict[str, float] = EXPLORATORY_GATE) -> Column:
    return F.array_compact(
        F.array(
            _fails("train_matches", F.col("train_n_matches") >= g["min_matches"]),
            _fails("train_lift", F.col("train_lift") >= g["min_lift"]),
            _fails("train_p_value", F.col("train_p_value") < g["max_p"]),
            _fails("holdout_lift", F.col("holdout_lift") >= g["min_holdout_lift"]),
        )
    )


def holdout_passes(g: dict[str, float] = GATE) -> Column:
    """The holdout-only screen, run before any training label is paid for."""
    return F.coalesce((F.col("holdout_lift") >= g["min_holdout_lift"]) & (F.col("holdout_p_value") < g["max_holdout_p"]), F.lit(False))


def failure_group(g: dict[str, float] = GATE) -> Column:
    train = F.coalesce(
        (F.col("train_n_matches") >= g["min_matches"]) & (F.col("train_lift") >= g["min_lift"])
        & (F.col("train_p_value") < g["max_p"]) & (F.col("train_ci_low") > g["min_ci_low"]), F.lit(False),
    )
    hold = holdout_passes(g)
    return (
        F.when(F.size(gate_reasons(g)) == 0, F.lit("graduated"))
        .when(train & ~hold, F.lit("real before the cutoff, not after"))
        .when(hold & ~train, F.lit("real after the cutoff, not before"))
        .when((F.col("holdout_n_matches") == 1) & (F.col("holdout_n_hits") == 1), F.lit("one event"))
        .otherwise(F.lit("no effect"))
    )


# --- tables over sessions -----------------------------------------------------------------------


def reaction_sessions(announcements: DataFrame, days: DataFrame) -> DataFrame:
    """The first session strictly after each announcement: ``series_id, timestamp``."""
    found = asof.value_at_or_after(announcements, days, "announced_at", "_n", inclusive=False)
    return found.filter(F.col("_n").isNotNull()).select(*KEY, F.col("_n.at").alias("timestamp")).distinct()


def anchor_table(days: DataFrame, reactions: DataFrame, threshold_pct: float, calm: float, elevated: float) -> DataFrame:
    """Shock rate under overlapping conditions knowable before the session.

    A session contributes one row to each condition it meets, then one aggregate.
    """
    shocked = days.withColumn("shock", is_shock(threshold_pct))
    prev = shocked.withColumn("_after", F.lag("shock").over(_in_order()))
    flagged = prev.join(reactions.withColumn("_react", F.lit(True)), [*KEY, "timestamp"], "left")
    react, vol = F.coalesce("_react", F.lit(False)), F.col("vol_before")
    named = {
        "all sessions": F.lit(True),
        "no announcement, calm": ~react & (vol < calm),
        "no announcement, normal": ~react & (vol >= calm) & (vol <= elevated),
        "no announcement, elevated": ~react & (vol > elevated),
        "day after a shock": F.coalesce("_after", F.lit(False)),
        "announcement reaction": react,
    }
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return flagged.withColumn("condition", F.explode(met)).groupBy(*KEY, "condition").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("shock").alias("shocks"),
        F.count_if(F.col("shock") & (F.col("return_pct") > 0)).alias("up"),
        F.count_if(F.col("shock") & (F.col("return_pct") < 0)).alias("down"),
        F.avg(F.col("shock").cast("double")).alias("rate"),
    )


def shock_headline(days: DataFrame, threshold_pct: float) -> DataFrame:
    hit = is_shock(threshold_pct)
    return days.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(hit).alias("shock_sessions"),
        F.count_if(hit & (F.col("return_pct") > 0)).alias("up"), F.count_if(hit & (F.col("return_pct") <= 0)).alias("down"),
        F.round(F.avg(hit.cast("double")) * 100, 1).alias("share_pct"),
    )


def shock_in_window(scored: DataFrame, days: DataFrame, threshold_pct: float) -> DataFrame:
    """Flag forecasts whose ``[as_of day, forecast_date]`` contains a shock session."""
    probes = scored.withColumn("_lo", cal.midnight("as_of"))
    flagged = asof.spans_hit(probes, days.filter(is_shock(threshold_pct)), "_lo", "forecast_date", "timestamp", KEY, "shock_in_window")
    return flagged.drop("_lo")


# --- calendars of events ----------------------------------------------------------------------------


def decision_outcomes(announcements: DataFrame, rates: DataFrame, lookahead_days: int = 7) -> DataFrame:
    """-1 / 0 / +1 per announcement from the last rate before it and the first one after it."""
    both = asof.around(announcements, rates, "announced_at", lookahead_days)
    change = F.col("after.value") - F.col("before.value")
    return both.select(
        *KEY, F.col("announced_at").alias("timestamp"),
        F.when(change < 0, F.lit(-1.0)).when(change > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
        F.col("announced_at").alias("released_at"),
    )


def unexplained_changes(rates: DataFrame, announcements: DataFrame, within_days: int = 7) -> DataFrame:
    """Rate changes inside the calendar's span with no announcement in ``[d - within, d]``."""
    from tidemark.operators.features import change_points

    changes = change_points(rates)
    spans = announcements.groupBy(*KEY).agg(F.min("announced_at").alias("_lo"), cal.plus_days(F.max("announced_at"), within_days).alias("_hi"))
    inside = changes.join(spans, KEY).filter(F.col("timestamp").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    last = asof.state_at(inside, announcements, KEY, "timestamp", F.col("announced_at"), {"_a": ("max", F.col("announced_at"))})
    return last.filter(F.col("_a").isNull() | (cal.plus_days("_a", within_days) < F.col("timestamp"))).drop("_a")


# --- paired comparison of arms ---------------------------------------------------------------------------------


def brier_board(scored: DataFrame, reference: str, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """Brier, skill and separation of each arm against the reference on the same spec, with paired intervals."""
    keys = list(keys)
    board = scored.groupBy(*keys, "predictor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual").cast("long").alias("shocks"), F.avg("score").alias("brier"),
        F.avg(F.when(F.col("actual") == 1, F.col("probability"))).alias("mean_p_shock"),
        F.avg(F.when(F.col("actual") == 0, F.col("probability"))).alias("mean_p_calm"),
    ).withColumn("separation", F.col("mean_p_shock") - F.col("mean_p_calm"))
    ref = board.filter(F.col("predictor_id") == reference).select(*keys, F.col("brier").alias("_ref"))
    board = board.join(ref, keys, "left").withColumn("brier_skill", F.when(F.col("_ref") > 0, F.lit(1.0) - F.col("brier") / F.col("_ref"))).drop("_ref")
    mine = scored.filter(F.col("predictor_id") != reference).select(*keys, "predictor_id", "as_of", "score")
    base = scored.filter(F.col("predictor_id") == reference).select(*keys, "as_of", F.col("score").alias("_b"))
    diffs = mine.join(base, [*keys, "as_of"]).withColumn("diff", F.col("score") - F.col("_b"))
    return board.join(paired_bootstrap(diffs, [*keys, "predictor_id"]), [*keys, "predictor_id"], "left")


def drop_leaked(scored: DataFrame, flag: str = "leaked", keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """An origin leaked in any arm leaves every arm, so comparisons stay paired."""
    bad = scored.filter(F.col(flag)).select(*keys, "as_of").distinct()
    return scored.join(bad, [*keys, "as_of"], "left_anti")


def quotes_value(record: Column, value: Column) -> Column:
    """Does the text quote the value to the cent, allowing one cent either way?"""
    text = lambda cents: fixed_text(value + F.lit(cents / 100.0), F.lit(2))
    return record.contains(text(-1)) | record.contains(text(0)) | record.contains(text(1))


def outcome_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Frozen outcomes that no longer agree with the data on the next business day."""
    probes = expected.withColumn("timestamp", cal.add_business_days("as_of", 1))
    seen = actual.select(*KEY, "timestamp", F.col("value").alias("resolved"))
    return probes.join(seen, [*KEY, "timestamp"], "left").filter(~F.col("resolved").eqNullSafe(F.col("expected")))


def stale_origins(origins: DataFrame, forbidden: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Origins that fall inside a forbidden window (must be empty)."""
    return asof.intervals_containing(origins, forbidden, "as_of", lo, hi, KEY)


def oot_origins(days: DataFrame, threshold_pct: float) -> DataFrame:
    """One-time evaluation spec: sessions followed by a session on the next business day, with its outcome."""
    nxt = days.select(*KEY, F.col("timestamp").alias("_next"), is_shock(threshold_pct).cast("int").alias("expected"))
    return days.select(*KEY, F.col("timestamp").alias("as_of"), cal.add_business_days("timestamp", 1).alias("_next")).join(nxt, [*KEY, "_next"]).drop("_next")
