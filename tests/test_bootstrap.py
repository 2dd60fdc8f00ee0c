"""Bootstrap by hashed weights against counts drawn one row at a time, in SQL and from the definition."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as bs

DIFFS = "arm string, part int, as_of timestamp_ntz, diff double"


def test_weights_are_poisson_counts_and_agree_with_sql():
    rng = np.random.default_rng(1)
    w = bs.weights(rng.integers(0, bs.PRIME, 4000), bs.resample_draws(300, 7))
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.003)
    # resamples weigh rows independently of one another
    c = np.corrcoef(w, rowvar=False)
    assert np.abs(c[~np.eye(300, dtype=bool)]).max() < 0.12
    draws = [0, 1, bs.PRIME - 1, 123_456_789]
    mine = bs.weights(np.array(draws), bs.resample_draws(40, 7))
    told = duckdb.sql(f"SELECT draw, b, {bs.weight_sql('draw', 'b', 7)} FROM (SELECT unnest({draws}) AS draw), (SELECT unnest(range(0, 40)) AS b)").fetchall()
    assert {(d, b): n for d, b, n in told} == {(d, b): mine[i, b] for i, d in enumerate(draws) for b in range(40)}


def test_sums_of_every_resample(spark):
    """Several keys, one of them null and one with most rows; spread over blocks, partitions and repeats of a difference."""
    rng = np.random.default_rng(2)
    rows = []
    for arm, part, n in (("hot", 1, 3000), ("cold", 2, 5), (None, 3, 40)):
        rows += [(arm, part, dt.datetime(2015, 1, 1) + dt.timedelta(hours=19 * i), float(np.round(rng.normal(), 1))) for i in range(n)]
    rows.append(("cold", 2, dt.datetime(2030, 1, 1), None))
    got = bs.resample_sums(spark.createDataFrame(rows, DIFFS).repartition(6), ["arm", "part"], resamples=50, seed=3).collect()
    assert len(got) == 150
    draws = {}
    for r in spark.createDataFrame(rows, DIFFS).select("arm", "part", "as_of", bs.row_draw(*[F.col(c) for c in ("arm", "part", "as_of")]).alias("d")).collect():
        draws[r.arm, r.part, r.as_of] = r.d
    kept = [r for r in rows if r[3] is not None]
    w = bs.weights(np.array([draws[r[:3]] for r in kept]), bs.resample_draws(50, 3))
    for r in got:
        mine = np.array([k[:2] == (r.arm, r.part) for k in kept])
        assert r.weight == w[mine, r["_b"]].sum()
        assert r.total == pytest.approx((w[mine, r["_b"]] * np.array([k[3] for k in kept])[mine]).sum())


def test_interval_against_drawing_with_replacement(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(size=80) - 0.7
    rows = [("a", 0, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    r = bs.paired_bootstrap(spark.createDataFrame(rows, DIFFS), ["arm"]).first()
    lo, hi = np.quantile(rng.choice(x, (20_000, 80)).mean(axis=1), [0.05, 0.95])
    assert r.diff_lo == pytest.approx(lo, abs=0.1 * (hi - lo)) and r.diff_hi == pytest.approx(hi, abs=0.1 * (hi - lo))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([("a", 0, dt.datetime(2020, 1, 1), 2.5)], DIFFS)
    r = bs.paired_bootstrap(one, ["arm"]).first()
    assert (r.diff_lo, r.diff_hi) == (2.5, 2.5)
    assert bs.paired_bootstrap(one.filter("1 = 0"), ["arm"]).count() == 0
