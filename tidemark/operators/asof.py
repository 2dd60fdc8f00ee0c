"""What was known when: cutoff filters and as-of joins.

Every as-of question is answered by one union of observations and probes, ordered
by the time that matters (release or stamp) and folded with
:func:`tidemark.operators.ordered.running`.  Nothing pairs an origin with its whole
history, so the cost is linear in rows and independent of skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ordered import BLOCK_SECONDS, DAY, block_of, row_index, running


def released(prefix: str = "") -> Column:
    """When a row became visible: its release stamp, or its own stamp when that is null."""
    return F.coalesce(F.col(f"{prefix}released_at"), F.col(f"{prefix}timestamp"))


def as_of(observations: DataFrame, cutoff: Column | str) -> DataFrame:
    """Rows visible at one inclusive cutoff.  The predicate reaches the scan."""
    moment = F.lit(cutoff).cast("timestamp_ntz") if isinstance(cutoff, str) else cutoff
    stamped = F.col("timestamp") <= moment
    if "released_at" not in observations.columns:
        return observations.filter(stamped)
    # Written without coalesce so that each comparison can be pushed into the scan.
    return observations.filter((F.col("released_at") <= moment) | (F.col("released_at").isNull() & stamped))


def state_at(
    probes: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    probe_time: str,
    row_time: Column,
    folds: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    forward: bool = False,
    block_seconds: int = BLOCK_SECONDS,
    many_per_time: bool = False,
) -> DataFrame:
    """For each probe, fold all rows of its key at/before (or at/after) the probe's time.

    ``folds`` is as in :func:`running`.  Probes keep all their columns; a probe with no
    qualifying row gets nulls (zero for a count comes from ``coalesce`` downstream).  Set
    ``many_per_time`` when a key holds many rows of one stamp (documents of one day): they
    are folded to one row per stamp first, on the map side, so a hot key stays small.
    """
    on = list(on)
    inputs = rows.select(
        *on,
        row_time.alias("_t"),
        F.lit(0 if inclusive else 1).alias("_side"),
        *[e.alias(f"_f_{n}") for n, (_, e) in folds.items()],
    )
    if many_per_time:
        combine = {"sum": F.sum, "max": F.max, "min": F.min}
        inputs = inputs.groupBy(*on, "_t", "_side").agg(*[combine[k](f"_f_{n}").alias(f"_f_{n}") for n, (k, _) in folds.items()])
    asked = probes.select(
        *on,
        F.col(probe_time).alias("_t"),
        F.lit(1 if inclusive else 0).alias("_side"),
        F.struct(*[F.col(c) for c in probes.columns if c not in on]).alias("_probe"),
    )
    both = inputs.unionByName(asked, allowMissingColumns=True)
    folded = running(
        both,
        on,
        "_t",
        {n: (k, F.col(f"_f_{n}")) for n, (k, _) in folds.items()},
        tie=[F.col("_side").asc()],
        ascending=not forward,
        block_seconds=block_seconds,
    )
    rest = [c for c in probes.columns if c not in on]
    return folded.filter(F.col("_probe").isNotNull()).select(
        *on, *[F.col(f"_probe.{c}").alias(c) for c in rest], *folds
    )


def latest(*columns: str, order: str = "timestamp") -> tuple[str, Column]:
    """Fold keeping the row with the greatest ``order``, as a struct.  Nulls in the first column are skipped."""
    return "max", F.struct(F.col(order).alias("at"), *[F.col(c) for c in columns])


def earliest(*columns: str, order: str = "timestamp") -> tuple[str, Column]:
    return "min", F.struct(F.col(order).alias("at"), *[F.col(c) for c in columns])


def count_rows() -> tuple[str, Column]:
    return "sum", F.lit(1).cast("long")


def visible_state(
    origins: DataFrame,
    observations: DataFrame,
    extra: dict[str, tuple[str, Column]] | None = None,
    *,
    origin_time: str = "as_of",
    on: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Per origin: ``n_visible`` and ``last`` = STRUCT<at, value> of the latest *stamp* among released rows.

    Folding by release time while keeping the greatest stamp is right even when
    releases arrive out of stamp order.
    """
    folds = {"n_visible": count_rows(), "last": latest("value"), **(extra or {})}
    out = state_at(origins, observations, on, origin_time, released(), folds)
    return out.withColumn("n_visible", F.coalesce("n_visible", F.lit(0).cast("long")))


STAMP = 26  # characters of a stamp with microseconds


def vintages(origins: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows visible at each origin, copied under an id of their own; returns ``(origins, rows)`` with that id.

    For origins that see a row while an earlier stamp is still unreleased: there, lags and
    fills must be made of the visible rows alone.  The copies are as many as those origins'
    histories hold.  ``root_id`` keeps the series; :func:`root` reads it from the new id.
    """
    own = F.concat(F.rpad(F.col("as_of").cast("string"), STAMP, " "), F.col("series_id"))
    moments = origins.select("series_id", "as_of").distinct()
    seen = observations.join(moments, "series_id").filter(released() <= F.col("as_of"))
    rows = seen.select(own.alias("series_id"), F.col("series_id").alias("root_id"), *[c for c in observations.columns if c != "series_id"])
    return origins.withColumn("series_id", own), rows


def root(vintage: Column) -> Column:
    """The series behind an id made by :func:`vintages`."""
    return F.substr(vintage, F.lit(STAMP + 1))


def value_at_or_before(
    probes: DataFrame, observations: DataFrame, probe_time: str, name: str, *, inclusive: bool = True,
    on: Sequence[str] = ("series_id",),
) -> DataFrame:
    """As-of backward on the stamp: adds ``name`` = STRUCT<at, value>."""
    return state_at(probes, observations, on, probe_time, F.col("timestamp"), {name: latest("value")}, inclusive=inclusive)


def value_at_or_after(
    probes: DataFrame, observations: DataFrame, probe_time: str, name: str, *, inclusive: bool = True,
    on: Sequence[str] = ("series_id",),
) -> DataFrame:
    """As-of forward on the stamp: the first row at/after (or strictly after) the probe."""
    return state_at(
        probes, observations, on, probe_time, F.col("timestamp"), {name: earliest("value")}, inclusive=inclusive, forward=True
    )


def around(probes: DataFrame, observations: DataFrame, probe_time: str, within_days: int) -> DataFrame:
    """Last value strictly before each event and first value in ``(event, event + within_days]``.

    Events lacking either side are dropped.
    """
    before = value_at_or_before(probes, observations, probe_time, "before", inclusive=False)
    both = value_at_or_after(before, observations, probe_time, "after", inclusive=False)
    limit = F.timestamp_add("DAY", F.lit(within_days), F.col(probe_time))
    return both.filter(F.col("before").isNotNull() & (F.col("after.at") <= limit))


def trailing_visible(
    origins: DataFrame, observations: DataFrame, n: int, *, origin_time: str = "as_of"
) -> DataFrame:
    """The ``n`` latest visible rows per origin, newest ``rank`` 1.

    Positions by stamp bound the search exactly: if the latest visible row sits at
    position R and v rows are visible, then R - v rows below it are still unreleased,
    so the answer lies in positions (R - n - (R - v), R].  Each origin asks for those
    positions with an equi-join.  Rows are unique per (series, timestamp).
    """
    indexed = row_index(observations, ["series_id"], "timestamp", "idx")
    state = state_at(
        origins, indexed, ["series_id"], origin_time, released(), {"_v": count_rows(), "_r": ("max", F.col("idx"))}
    )
    low = F.greatest(F.col("_v") - F.lit(n) + 1, F.lit(1).cast("long"))
    wanted = state.filter(F.col("_v") > 0).withColumn("idx", F.explode(F.sequence(low, F.col("_r")))).drop("_v", "_r")
    joined = wanted.join(indexed, ["series_id", "idx"]).filter(released() <= F.col(origin_time))
    keys = [c for c in origins.columns]
    newest = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc())
    return joined.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n).drop("idx")


def intervals_containing(
    points: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, on: Sequence[str] = (), bucket_seconds: int = 32 * DAY
) -> DataFrame:
    """Range join ``lo <= point <= hi`` as an equi-join on time buckets (spans repeat once per bucket they touch)."""
    buckets = F.sequence(block_of(F.col(lo), bucket_seconds), block_of(F.col(hi), bucket_seconds))
    right = spans.filter(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(buckets))
    left = points.withColumn("_bucket", block_of(F.col(point), bucket_seconds))
    return left.join(right, [*on, "_bucket"]).filter((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("_bucket")


def outside_all_spans(points: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, on: Sequence[str] = ()) -> DataFrame:
    """Points inside none of the spans (range anti join)."""
    hit = intervals_containing(points.select(*on, point), spans.select(*on, lo, hi), point, lo, hi, on).select(*on, point)
    return points.join(hit.distinct(), [*on, point], "left_anti")


def spans_hit(spans: DataFrame, points: DataFrame, lo: str, hi: str, point: str, on: Sequence[str], name: str) -> DataFrame:
    """Flag each span that contains at least one point (range exists).

    Counting points up to each end needs no pairing: a span is hit when the count at
    its end exceeds the count strictly before its start.
    """
    at_end = state_at(spans, points, on, hi, F.col(point), {"_to": count_rows()}, inclusive=True)
    at_both = state_at(at_end, points, on, lo, F.col(point), {"_from": count_rows()}, inclusive=False)
    hit = F.coalesce("_to", F.lit(0).cast("long")) > F.coalesce("_from", F.lit(0).cast("long"))
    return at_both.withColumn(name, hit).drop("_to", "_from")
