"""The mixture of single windows at the settings of op4, and targets of small sources."""

from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import packing


def windows(got):
    return got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)


def test_every_window_has_every_source_in_proportion(small):
    got = packing.pack(small).toPandas()
    shares = got.groupby("source")["length"].sum() / got["length"].sum()
    # the last quanta of the queues, each shorter than a quantum, follow at the end
    per = windows(got).iloc[: -1 - -(-len(shares) * 16 // 1024)]
    assert len(per) > 20 and (per > 0).all(axis=None) and (np.abs(per - 1024 * shares) <= 32).all(axis=None)


def test_a_small_source_named_in_targets_has_its_own_queue(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)), f"big{i % 2}") for i in range(400)] + [(1000 + i, f"tiny text {i}", "tiny") for i in range(10)] + [(2000, "other", "rest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, targets={"tiny": 0.05, "big0": 0.7, "big1": 0.25}).toPandas()
    per = windows(got)
    # at 5 % of each window the few tokens of the source are used up in the first; its tail ends the stream
    tiny = per["tiny"].to_numpy()
    assert tiny[0] >= tiny.sum() - 16 and tiny[0] > 0
    first = per.iloc[:5]
    assert (np.abs(first["big0"] - 1024 * 0.7) <= 64).all() and (np.abs(first["big1"] - 1024 * 0.25) <= 64).all()


def test_decimal_weights_give_every_place_once():
    rng = np.random.default_rng(8)
    for _ in range(300):
        weights = [Fraction(str(round(float(w), 2))) for w in rng.uniform(0.01, 1, 5)]
        tokens = rng.integers(0, 4000, 5).tolist()
        made = packing.Schedule(tokens, weights, 16)
        places = np.concatenate([made.rank(q, np.arange(n)) for q, n in enumerate(made.full.tolist())])
        assert (np.sort(places) == np.arange(made.full.sum())).all()


def test_decimal_targets_pack_without_overlap_or_gap(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 500, rng.integers(1, 300))), f"s{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, targets={"s0": 0.55, "s1": 0.03, "s2": 0.75, "s3": 0.54, "s4": 0.33}).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in got.groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.r_[0, s["length"].cumsum()[:-1]]).all()
    for _, d in got.sort_values("start").groupby("doc_id"):
        assert (d["start"].to_numpy() == np.r_[0, d["length"].cumsum()[:-1]]).all() and d["length"].sum() == d["doc_tokens"].iloc[0]


@pytest.mark.parametrize("window, shares, quantum", [(1024, [0.5, 0.47, 0.03], 16), (1024, [0.99, 0.01], 8), (1024, [0.5, 0.5], 16), (4096, [0.97, 0.03], 64), (8, [0.5, 0.5], 1), (1024, [], 16)])
def test_quantum_follows_the_window_and_the_smallest_share(window, shares, quantum):
    assert packing.quantum_for(window, shares) == quantum
