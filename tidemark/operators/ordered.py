"""Ordered operators that do not need a whole series in one task.

A plain ``Window.partitionBy(series).orderBy(time)`` sends every row of a series to
one task, so one hot series would hold up the job.  Both primitives here split a
series into time blocks, run an ordinary window inside each block, and carry over
only what the next blocks need:

* :func:`running` - prefix folds (count, sum, max, min).  Blocks are first reduced
  to one row each (partial aggregation before the shuffle), the block totals are
  accumulated, and every row adds the total of the blocks before its own.
* :func:`trailing` - any frame that looks back at most ``lookback`` rows.  The last
  ``lookback`` rows before each block are copied in front of it and dropped again.

The number of blocks per key is bounded by the calendar span over ``block_seconds``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import settled

DAY = 86_400
BLOCK_SECONDS = 512 * DAY  # about two years of a daily series, 12k rows of an hourly one

_BLOCK = "_block"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def block_of(time: Column, block_seconds: int = BLOCK_SECONDS) -> Column:
    seconds = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.floor(F.timestamp_diff("SECOND", seconds, time) / F.lit(block_seconds))


def _order(names: Sequence[str], ascending: bool) -> list[Column]:
    return [F.col(n).asc() if ascending else F.col(n).desc() for n in names]


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def running(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    folds: dict[str, tuple[str, Column]],
    *,
    tie: Sequence[Column] = (),
    ascending: bool = True,
    block_seconds: int = BLOCK_SECONDS,
    block: Column | None = None,
) -> DataFrame:
    """Add, for each row, each fold over all rows of its key up to and including it.

    ``folds`` maps a new column to ``(kind, expression)`` with kind ``sum``, ``max`` or
    ``min``; null inputs are skipped.  The last non-null value in time order is
    ``("max", struct(time, value))`` because time only grows.  ``tie`` orders equal
    stamps; ``ascending=False`` folds from the end of the series backwards.  ``time`` may be
    any ordered column when ``block``, a non-decreasing function of it, is given.
    """
    keys = list(keys)
    inputs = df.select("*", *[e.alias(f"_in_{n}") for n, (_, e) in folds.items()]).withColumn(
        _BLOCK, block if block is not None else block_of(F.col(time), block_seconds)
    )
    order = [F.col(time).asc() if ascending else F.col(time).desc(), *tie]
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = inputs.select(
        *df.columns, _BLOCK, *[_AGG[k](f"_in_{n}").over(inside).alias(f"_own_{n}") for n, (k, _) in folds.items()]
    )
    totals = inputs.groupBy(*keys, _BLOCK).agg(*[_AGG[k](f"_in_{n}").alias(f"_sum_{n}") for n, (k, _) in folds.items()])
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(_BLOCK).asc() if ascending else F.col(_BLOCK).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys, _BLOCK, *[_AGG[k](f"_sum_{n}").over(before).alias(f"_pre_{n}") for n, (k, _) in folds.items()]
    )
    return local.join(carried, [*keys, _BLOCK]).select(
        *df.columns, *[_merge(k, F.col(f"_pre_{n}"), F.col(f"_own_{n}")).alias(n) for n, (k, _) in folds.items()]
    )


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    lookback: int,
    build: Callable[[Window], dict[str, Column]] | Sequence[Callable[[Window], dict[str, Column]]],
    *,
    ascending: bool = True,
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Add window columns whose frames reach at most ``lookback`` rows back.

    ``build`` gets the ordered window spec and returns ``{name: column}``, e.g.
    ``lambda w: {"prev": F.lag("value").over(w)}``.  A list of builders runs in turn over
    the same blocks, each seeing the columns before it; ``lookback`` is then their sum.
    With ``ascending=False`` "back" means later rows, which turns the call into a lead.
    """
    keys = list(keys)
    blocks = df.withColumn(_BLOCK, block_of(F.col(time), block_seconds))
    direction = _order([time], ascending)
    last_first = Window.partitionBy(*keys, _BLOCK).orderBy(*_order([time], not ascending))
    payload = [c for c in df.columns if c not in keys]
    tails = (
        blocks.withColumn("_rank", F.row_number().over(last_first))
        .filter(F.col("_rank") <= lookback)
        .groupBy(*keys, _BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct(time, *[c for c in payload if c != time])), ascending).alias("_tail"))
    )
    # Every block holds at least one row, so the last `lookback` blocks hold enough of them.
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(F.col(_BLOCK).asc() if ascending else F.col(_BLOCK).desc())
        .rowsBetween(-lookback, -1)
    )
    halo = (
        tails.withColumn("_tail", F.flatten(F.collect_list("_tail").over(earlier)))
        .withColumn("_tail", F.slice("_tail", F.greatest(F.size("_tail") - lookback + 1, F.lit(1)), F.lit(lookback)))
        .select(*keys, _BLOCK, F.explode("_tail").alias("_row"))
        .select(*keys, _BLOCK, *[F.col(f"_row.{c}").alias(c) for c in payload], F.lit(True).alias("_halo"))
    )
    both = blocks.withColumn("_halo", F.lit(False)).unionByName(halo)
    w = Window.partitionBy(*keys, _BLOCK).orderBy(*direction)
    for stage in build if isinstance(build, (list, tuple)) else [build]:
        both = both.withColumns(stage(w))
    return both.filter(~F.col("_halo")).drop("_halo", _BLOCK)


def row_index(df: DataFrame, keys: Sequence[str], time: str, name: str = "idx", **kw) -> DataFrame:
    """One-based position of each row in its series."""
    return running(df, keys, time, {name: ("sum", F.lit(1).cast("long"))}, **kw)


def lags(df: DataFrame, keys: Sequence[str], time: str, new: dict[str, tuple[str, int]], **kw) -> DataFrame:
    """Row lags: ``new`` maps a column name to ``(source column, rows back)``."""
    deepest = max(k for _, k in new.values())
    return trailing(df, keys, time, deepest, lambda w: {n: F.lag(c, k).over(w) for n, (c, k) in new.items()}, **kw)


def leads(df: DataFrame, keys: Sequence[str], time: str, new: dict[str, tuple[str, int]], **kw) -> DataFrame:
    return lags(df, keys, time, new, ascending=False, **kw)


def fill_forward(df: DataFrame, keys: Sequence[str], time: str, column: str = "value", **kw) -> DataFrame:
    """Carry the last non-null value forward."""
    seen = F.when(F.col(column).isNotNull(), F.struct(F.col(time).alias("t"), F.col(column).alias("v")))
    filled = running(df, keys, time, {"_last": ("max", seen)}, **kw)
    return filled.withColumn(column, F.col("_last.v")).drop("_last")


def interpolate(df: DataFrame, keys: Sequence[str], time: str, column: str = "value", **kw) -> DataFrame:
    """Fill interior gaps on the straight line between neighbours, by row position.

    Leading and trailing gaps take the nearest value, as a series that must be
    contiguous for a fit needs them.
    """
    indexed = row_index(df, keys, time, "_i", **kw)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).alias("v")))
    back = running(indexed, keys, time, {"_lo": ("max", known)}, **kw)
    both = running(back, keys, time, {"_hi": ("min", known)}, ascending=False, **kw)
    lo, hi = F.col("_lo"), F.col("_hi")
    line = lo["v"] + (hi["v"] - lo["v"]) * (F.col("_i") - lo["i"]) / (hi["i"] - lo["i"])
    value = F.coalesce(F.col(column), line, lo["v"], hi["v"])
    return both.withColumn(column, value).drop("_i", "_lo", "_hi")


def value_blocks(values: DataFrame, keys: Sequence[str], column: str, blocks: int = 256) -> DataFrame:
    """Add ``_bucket``, splitting each key's values into about equal ranges.

    The edges come from a mergeable sketch of bounded size; any edges are right, they only
    decide how evenly the work spreads.  What the sketch gives depends on the order in which its
    parts meet, so the edges are stored: every use of the result sees the same ones.
    """
    levels = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    edges = settled(values.groupBy(*keys).agg(F.percentile_approx(column, levels, 1_000).alias("_edges")), "edges")
    # Bisection over the sorted edges: how many lie below the value.
    start = F.struct(F.lit(0).alias("lo"), F.lit(blocks - 1).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get("_edges", mid) < F.col(column)
        open_ = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"),
        )

    rounds = F.sequence(F.lit(1), F.lit(blocks.bit_length()))
    return values.join(edges, list(keys)).withColumn("_bucket", F.aggregate(rounds, start, halve, lambda a: a["lo"])).drop("_edges")


def exact_percentiles(df: DataFrame, keys: Sequence[str], column: str, levels: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key without holding a group in one place.

    Rows are first counted per distinct value, cumulative counts run over value ranges,
    and the two values around each wanted rank are picked by rank.
    """
    keys = list(keys)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(value_blocks(counts, keys, "_v"), keys, "_v", {"_cum": ("sum", F.col("_c"))}, block=F.col("_bucket"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = ranked.join(sizes, keys)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum")), F.col("_v")))

    picks = []
    for name, q in levels.items():
        position = (F.col("_n") - 1) * F.lit(float(q))
        low = F.floor(position)
        picks += [value_at(low).alias(f"_lo_{name}"), value_at(F.least(low + 1, F.col("_n") - 1)).alias(f"_hi_{name}")]
    out = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)

    def between(name: str, q: float) -> Column:
        position = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return lo + (hi - lo) * (position - F.floor(position))

    return out.select(*keys, *[between(n, q).alias(n) for n, q in levels.items()])


def expanding_percentiles(
    df: DataFrame, keys: Sequence[str], time: str, column: str, levels: dict[str, float], *, min_history: int = 1, width: int = 256, span: int = 64, salts: int = 8
) -> DataFrame:
    """``keys, time`` and linear-interpolated percentiles of all values of the key up to and including each row.

    Order statistics over value ranges with running counts.  Every value gets its rank in the key, ranges hold ``width``
    ranks, and for every ``span`` rows in time order it is known how many earlier values lie below each range.  A row finds
    the range of a wanted rank by bisection over those counts and the few rows of its own span, then picks the value inside the
    range among those seen by then.  Nothing holds a key's rows, and equal values are told apart by time.  Rows without a
    value, and rows with fewer than ``min_history`` values so far, are left out.
    """
    keys = list(keys)
    known = df.filter(F.col(column).isNotNull() & ~F.isnan(column)).select(*keys, F.col(time).alias("_at"), F.col(column).cast("double").alias("_v"))
    dated = row_index(known, keys, "_at", "_pos")
    ranked = running(value_blocks(dated, keys, "_v"), keys, "_v", {"_rank": ("sum", F.lit(1).cast("long"))}, tie=[F.col("_pos")], block=F.col("_bucket"))
    p, r = F.col("_pos") - 1, F.col("_rank") - 1
    placed = settled(ranked.select(*keys, "_at", "_v", p.alias("p"), r.alias("r"), F.floor(p / span).alias("tb"), F.floor(r / width).alias("vb")), "placed")

    last = placed.groupBy(*keys).agg(F.max("tb").alias("_tb"), F.max("vb").alias("_vb"))
    zero = F.lit(0).cast("long")
    grid = last.select(*keys, F.explode(F.sequence(zero, "_tb")).alias("tb"), "_vb").select(*keys, "tb", F.explode(F.sequence(zero, "_vb")).alias("vb"))
    counts = placed.groupBy(*keys, "tb", "vb").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy(*keys, "vb").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "tb").orderBy("vb").rowsBetween(Window.unboundedPreceding, -1)
    dense = grid.join(counts, [*keys, "tb", "vb"], "left").withColumn("c", F.coalesce(F.sum("c").over(earlier), zero))
    dense = dense.withColumn("c", F.coalesce(F.sum("c").over(lower), zero))
    below = dense.groupBy(*keys, "tb").agg(F.transform(F.sort_array(F.collect_list(F.struct("vb", "c"))), lambda x: x["c"]).alias("below"))
    inside = placed.groupBy(*keys, "tb").agg(F.sort_array(F.collect_list(F.struct("p", "_at", "vb"))).alias("rows"))

    rows = inside.join(below, [*keys, "tb"]).select(*keys, "below", F.transform("rows", lambda x: x["vb"]).alias("own"), F.posexplode("rows").alias("i", "row"))
    rows = rows.select(*keys, "below", F.slice("own", F.lit(1), F.col("i") + 1).alias("own"), "row.p", "row._at").filter(F.col("p") + 1 >= min_history)
    wanted = []
    for name, q in levels.items():
        low = F.floor(F.col("p") * F.lit(float(q)))
        wanted += [F.struct(F.lit(f"{name} 0").alias("which"), low.alias("k")), F.struct(F.lit(f"{name} 1").alias("which"), F.least(low + 1, F.col("p")).alias("k"))]
    asked = rows.select("*", F.explode(F.array(*wanted)).alias("w")).select(*keys, "below", "own", "p", "_at", "w.which", "w.k")

    def under(v: Column) -> Column:
        """How many values seen by the row lie in ranges below ``v``."""
        return F.get("below", v) + F.size(F.filter("own", lambda x: x < v))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        fits = under(mid) <= F.col("k")
        return F.struct(F.when(fits, mid).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), (F.size("below") - 1).alias("hi"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("below") + 1)).cast("int"))
    found = asked.withColumn("vb", F.aggregate(rounds, start, halve, lambda a: a["lo"]))
    probes = found.select(*keys, "p", "_at", "which", F.col("vb").cast("long").alias("vb"), (F.col("k") - under(F.col("vb"))).cast("int").alias("j"), (F.col("p") % salts).alias("salt"))
    ranges = placed.groupBy(*keys, "vb").agg(F.sort_array(F.collect_list(F.struct("r", "p", "_v"))).alias("in_range"))
    ranges = ranges.withColumn("salt", F.explode(F.sequence(zero, F.lit(salts - 1).cast("long"))))
    met = probes.join(ranges, [*keys, "vb", "salt"])
    value = F.get(F.filter("in_range", lambda x: x["p"] <= F.col("p")), F.col("j"))["_v"]
    picked = met.select(*keys, "p", "_at", "which", value.alias("value")).groupBy(*keys, "p", "_at").agg(
        *[F.max(F.when(F.col("which") == f"{name} {side}", F.col("value"))).alias(f"_{name}_{side}") for name in levels for side in (0, 1)]
    )

    def between(name: str, q: float) -> Column:
        at, low, high = F.col("p") * F.lit(float(q)), F.col(f"_{name}_0"), F.col(f"_{name}_1")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return picked.select(*keys, F.col("_at").alias(time), *[between(n, q) for n, q in levels.items()])
