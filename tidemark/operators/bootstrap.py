"""Bootstrap intervals of paired differences by weights instead of draws.

Resampling n rows with replacement gives each row a count; over many rows the counts are Poisson with mean one.  Every row works
out its own counts in all resamples from a hash of its key and moment, so a resample needs no positions, no look-up and no copy of the rows, and a
repeated task draws the same.  A resample's mean is its weighted sum over its sum of weights.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import block_of

RESAMPLES, SEED = 2000, 0
PRIME = 2**31 - 1
#: A draw below the first bound has weight 0, below the second 1, and so on; from the last one on, which one draw in a hundred million reaches, 11.
BOUNDS = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]
_MIX, _SHIFT = 1_103_515_245, 15
_CHUNK = 1024  # rows whose draws are held at once


def row_draw(*parts: Column) -> Column:
    """A whole number below :data:`PRIME` from the row's identity."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % PRIME


def resample_draws(resamples: int, seed: int) -> np.ndarray:
    """Factor and shift of every resample, as two rows."""
    def below(name: str) -> int:
        return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % (PRIME - 1)

    return np.array([[1 + below(f"{seed}|{b}|factor") for b in range(resamples)], [below(f"{seed}|{b}|shift") for b in range(resamples)]], dtype=np.int64)


def weights(draw: np.ndarray, resample: np.ndarray) -> np.ndarray:
    """Rows by resamples: the Poisson count of each row.  Products stay below 2^62."""
    u = (draw[:, None] * resample[0] + resample[1]) % PRIME
    u = ((u ^ (u >> _SHIFT)) * _MIX) % PRIME
    return np.searchsorted(np.array(BOUNDS), u, side="right")


def resample_sums(diffs: DataFrame, keys: Sequence[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``keys, _b, weight, total`` per resample.

    Rows travel once, to (key, block of time), and stand there key by key, so a task holds the sums of one key at a time
    and a key of any size is split by time.  Only the sums of a key's block leave the task.
    """
    keys = list(keys)
    draws = resample_draws(resamples, seed)
    rows = diffs.filter(F.col("diff").isNotNull()).select(*keys, F.col("diff").cast("double").alias("diff"), row_draw(*[F.col(c) for c in (*keys, "as_of")]).alias("_draw"), block_of(F.col("as_of")).alias("_block"))
    rows = rows.repartition(*keys, "_block").sortWithinPartitions(*keys)
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: keys.index(f.name))], "weight array<double>", "total array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, weight, total = None, np.zeros(resamples), np.zeros(resamples)

        def out() -> pd.DataFrame:
            return pd.DataFrame([[*now, weight, total]], columns=[*keys, "weight", "total"])

        for batch in batches:
            for found, part in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in found)
                if key != now:
                    if now is not None:
                        yield out()
                    now, weight, total = key, np.zeros(resamples), np.zeros(resamples)
                for at in range(0, len(part), _CHUNK):
                    some = part.iloc[at : at + _CHUNK]
                    w = weights(some["_draw"].to_numpy(), draws)
                    weight += w.sum(axis=0)
                    total += some["diff"].to_numpy() @ w
        if now is not None:
            yield out()

    parts = rows.mapInPandas(run, schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("weight", "total")).alias("_b", "_s"))
    return each.groupBy(*keys, "_b").agg(F.sum("_s.weight").alias("weight"), F.sum("_s.total").alias("total"))


def paired_bootstrap(diffs: DataFrame, keys: Sequence[str], resamples: int = RESAMPLES, level: float = 0.90, seed: int = SEED) -> DataFrame:
    """Percentile interval of the mean difference: ``keys, diff_lo, diff_hi``.

    ``diffs`` has the keys, a unique ``as_of`` and ``diff``; rows without a difference are left out, and so are resamples in which no row has weight.
    """
    means = resample_sums(diffs, keys, resamples, seed).filter("weight > 0").withColumn("_m", F.col("total") / F.col("weight"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    return bounds.select(*keys, F.col("_q")[0].alias("diff_lo"), F.col("_q")[1].alias("diff_hi"))


def weight_sql(draw: str, resample: str, seed: int = SEED) -> str:
    """The same count in DuckDB, for a row's draw and the number of a resample."""
    part = lambda name: f"(('0x' || substr(md5('{seed}|' || {resample} || '|{name}'), 1, 8))::BIGINT % {PRIME - 1})"
    u = f"(({draw} * (1 + {part('factor')}) + {part('shift')}) % {PRIME})"
    bounds = ", ".join(str(b) for b in BOUNDS)
    return f"list_transform([{u}], lambda u: len(list_filter([{bounds}], lambda t: t <= (xor(u, u >> {_SHIFT}) * {_MIX}) % {PRIME})))[1]"
