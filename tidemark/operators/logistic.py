"""Logistic models refitted at many origins at once.

An origin's training set is every example of its series known by then, so examples stand in blocks of bounded size and
an origin meets the blocks before it by an equi-join.  Every Newton round turns (origin, block) pairs into parts of
gradient and Hessian, adds them up by origin in one shuffle, and moves all origins that have not converged.  No group
holds a series, and an origin's sums do not grow with its history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import asof
from tidemark.operators.ordered import row_index
from tidemark.session import settled

KEY = ["series_id"]
BLOCK = 256



def example_blocks(rows: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """``keys, block, x, y``: the examples of a key in order, ``block`` to a row; ``x`` holds their feature arrays end to end."""
    numbered = row_index(rows, keys, order, "i")
    held = numbered.groupBy(*keys, F.floor((F.col("i") - 1) / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    return held.select(*keys, "block", F.flatten(F.transform("r", lambda r: r["x"])).alias("x"), F.transform("r", lambda r: r["y"]).alias("y"))


def meeting(state: DataFrame, blocks: DataFrame, keys: Sequence[str], width: int, block: int = BLOCK) -> DataFrame:
    """Each row of ``state`` with every block of its first ``n`` examples, cut to those; ``width`` features an example."""
    spread = state.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    both = spread.join(blocks.hint("merge"), [*keys, "block"]).withColumn("_m", F.least(F.size("y"), (F.col("n") - F.col("block") * block).cast("int")))
    return both.withColumn("y", F.slice("y", F.lit(1), F.col("_m"))).withColumn("x", F.slice("x", F.lit(1), F.col("_m") * width)).drop("_m")


_STATE = "base array<double>, step array<double>, scale double, loss double, done boolean, converged boolean, rounds int"
_FIXED = ["_id", "series_id", "as_of", "n", "now", "mean", "sd", "counts"]


def roles(counts: np.ndarray) -> np.ndarray:
    """Per class 0 absent, 1 present with its logit held at zero, 2 present with weights.

    Two present classes use the single-logit form, so the first of them has no weights.
    """
    role = np.where(np.asarray(counts) > 0, 2, 0)
    if (role > 0).sum() == 2:
        role[np.flatnonzero(role)[0]] = 1
    return role


def probabilities(z: np.ndarray, w: np.ndarray, role: np.ndarray) -> np.ndarray:
    logits = np.where(role == 0, -np.inf, np.where(role == 1, 0.0, z @ w.reshape(len(role), -1).T))
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def parts_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, role: np.ndarray) -> np.ndarray:
    """Log loss, gradient and upper half of the Hessian of one block, as one vector; classes without weights have zeros."""
    z = np.column_stack([np.ones(len(x)), x])
    d, k = z.shape[1], len(role)
    p = probabilities(z, w, role)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    free = role == 2
    grad = (((p - np.eye(k)[y]) * free).T @ z).ravel()
    weight = (p[:, :, None] * (np.eye(k) - p[:, None, :])) * (free[:, None] & free)
    hess = np.einsum("nij,na,nb->iajb", weight, z, z).reshape(k * d, k * d)
    return np.concatenate([[loss], grad, hess[np.triu_indices(k * d)]])


def moved(state: dict, sums: np.ndarray, penalty: np.ndarray, tolerance: float) -> dict:
    """One Newton round of one origin: keep the point if its loss fell and find the next step, else halve the step."""
    w = np.asarray(state["base"]) - state["scale"] * np.asarray(state["step"])
    size = len(w)
    loss = sums[0] + 0.5 * (penalty * w * w).sum()
    rounds = state["rounds"] + 1
    if not loss <= state["loss"] + 1e-12 * abs(loss):
        scale = state["scale"] / 2
        return {**state, "scale": scale, "rounds": rounds, "done": scale < 1e-9}
    grad = sums[1 : 1 + size] + penalty * w
    hess = np.zeros((size, size))
    hess[np.triu_indices(size)] = sums[1 + size :]
    hess = hess + np.triu(hess, 1).T + np.diag(penalty)
    step = np.linalg.lstsq(hess, grad, rcond=None)[0]
    small = bool(np.abs(step).max() < tolerance)
    return {"base": w, "step": step, "scale": 1.0, "loss": loss, "done": small, "converged": small, "rounds": rounds}


def fit_at_origins(
    origins: DataFrame, examples: DataFrame, features: Sequence[str], classes: Sequence[float],
    *, c: float = 1.0, min_train: int = 16, rounds: int = 50, tolerance: float = 1e-10, block: int = BLOCK,
) -> DataFrame:
    """Refit a (multinomial) logistic model at every origin on the examples known by then.

    ``origins``: ``series_id, as_of`` and the features now; ``examples``: ``series_id, known_at``, the features then and
    ``outcome``, one of ``classes``; examples with a missing feature or outcome are left out.  Features are standardised
    per origin, the loss plus ``|w|^2 / 2c`` is minimised (intercepts free).  Falls back to class frequencies with fewer than
    ``min_train`` examples, a single class, or missing features now.  ``converged`` is null for fallbacks and false where
    ``rounds`` were not enough.
    """
    names, k, d = list(features), len(classes), len(features) + 1
    whole = lambda cols: F.array(*[F.col(n).cast("double") for n in cols])
    known = lambda a: ~F.exists(a, lambda v: v.isNull() | F.isnan(v))
    past = examples.select("series_id", "known_at", whole(names).alias("x"), (F.array_position(F.array(*[F.lit(float(v)) for v in classes]), F.col("outcome").cast("double")) - 1).cast("int").alias("y"))
    past = settled(past.filter(known(F.col("x")) & (F.col("y") >= 0)), "past")
    blocks = settled(example_blocks(past, KEY, "known_at", block), "blocks")

    asked = origins.select("series_id", "as_of", whole(names).alias("now"))
    asked = asof.state_at(asked, past, KEY, "as_of", F.col("known_at"), {"n": asof.count_rows()}).withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    asked = settled(asked.withColumn("_id", F.monotonically_increasing_id()), "asked")

    each = meeting(asked.filter("n > 0").select("_id", *KEY, "n"), blocks, KEY, d - 1, block).select("_id", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("y") - 1).alias("j"), "y")).alias("e"), "x")
    at = lambda j: F.get("x", F.col("e.j") * (d - 1) + j)
    moments = each.groupBy("_id").agg(
        F.array(*[F.avg(at(j)) for j in range(d - 1)]).alias("mean"), F.array(*[F.stddev_pop(at(j)) for j in range(d - 1)]).alias("sd"),
        F.array(*[F.count_if(F.col("e.y") == i) for i in range(k)]).alias("counts"),
    )
    none = F.array(*[F.lit(0).cast("long")] * k)
    told = settled(asked.join(moments.hint("merge"), "_id", "left").withColumn("counts", F.coalesce("counts", none)), "moments")
    enough = (F.col("n") >= min_train) & (F.size(F.filter("counts", lambda v: v > 0)) >= 2) & known(F.col("now"))

    zeros = F.array(*[F.lit(0.0)] * (k * d))
    sd = F.transform("sd", lambda v: F.when(v == 0, 1.0).otherwise(v)).alias("sd")
    start = told.filter(enough).select(
        *[f for f in _FIXED if f != "sd"], sd, zeros.alias("base"), zeros.alias("step"), F.lit(1.0).alias("scale"), F.lit(float("inf")).alias("loss"),
        F.lit(False).alias("done"), F.lit(False).alias("converged"), F.lit(0).alias("rounds"),
    )
    width = 1 + k * d + k * d * (k * d + 1) // 2
    penalty = np.tile(np.r_[0.0, np.full(d - 1, 1.0 / c)], k)
    fields = [x.split()[0] for x in _STATE.split(", ")]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, mean, sd, counts, base, step, scale in zip(*(batch[n] for n in ("x", "y", "mean", "sd", "counts", "base", "step", "scale"))):
                z = (np.reshape(x, (-1, d - 1)) - mean) / sd
                out.append(parts_of(z, np.asarray(y), np.asarray(base) - scale * np.asarray(step), roles(counts)))
            yield pd.DataFrame({"_id": batch["_id"], "part": out})

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [moved(s, np.asarray(v), penalty, tolerance) for s, v in zip(batch[fields].to_dict("records"), batch["sums"])]
            yield pd.concat([batch[_FIXED].reset_index(drop=True), pd.DataFrame(new, columns=fields)], axis=1)

    schema = f"_id long, series_id string, as_of timestamp_ntz, n int, now array<double>, mean array<double>, sd array<double>, counts array<long>, {_STATE}"
    active = settled(start, "newton")
    finished = [active.filter("done")]
    for _ in range(rounds):
        if active.isEmpty():
            break
        sums = meeting(active.select("_id", *KEY, "n", "mean", "sd", "counts", "base", "step", "scale"), blocks, KEY, d - 1, block).mapInPandas(parts, "_id long, part array<double>")
        total = sums.groupBy("_id").agg(F.array(*[F.sum(F.col("part")[j]) for j in range(width)]).alias("sums"))
        after = settled(active.join(total.hint("merge"), "_id").mapInPandas(move, schema), "newton")
        finished.append(after.filter("done"))
        active = settled(after.filter("NOT done"), "newton")
    finished.append(active)
    fitted = finished[0]
    for f in finished[1:]:
        fitted = fitted.unionByName(f)

    def chances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = [
                probabilities(np.r_[1.0, (np.asarray(now) - mean) / sd][None, :], np.asarray(w), roles(counts))[0].tolist()
                for now, mean, sd, counts, w in zip(*(batch[n] for n in ("now", "mean", "sd", "counts", "base")))
            ]
            out = batch[["series_id", "as_of", "converged"]].assign(n_train=batch["n"], model="logistic", class_probs=p)
            yield out[["series_id", "as_of", "n_train", "model", "class_probs", "converged"]]

    result = "series_id string, as_of timestamp_ntz, n_train int, model string, class_probs array<double>, converged boolean"
    guess = F.array(F.lit(0.9), F.lit(0.1)) if k == 2 else F.array(*[F.lit(1.0 / k)] * k)
    shares = F.when(F.col("n") > 0, F.transform("counts", lambda v: v / F.col("n"))).otherwise(guess)
    rest = told.filter(~enough).select("series_id", "as_of", F.col("n").alias("n_train"), F.lit("frequency_fallback").alias("model"), shares.alias("class_probs"), F.lit(None).cast("boolean").alias("converged"))
    return fitted.mapInPandas(chances, result).unionByName(rest)
