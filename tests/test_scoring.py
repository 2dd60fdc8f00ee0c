import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring as sc, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def payload(values):
    return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(float(v)).alias("v")) for q, v in zip(sc.QUANTILE_LEVELS, values)])


def test_crps_small_ensemble(spark):
    assert one(spark, sc.crps(payload([1, 2, 4]), F.lit(2.5))) == pytest.approx(0.5)


def test_crps_equals_double_sum_and_point_mass(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, y = rng.normal(size=11), rng.normal()
        want = np.abs(x - y).mean() - np.abs(x[:, None] - x[None, :]).sum() / (2 * 121)
        assert one(spark, sc.crps(payload(x), F.lit(float(y)))) == pytest.approx(want)
    assert one(spark, sc.crps(payload([3.0] * 11), F.lit(5.5))) == pytest.approx(2.5)


@pytest.mark.parametrize("index,want", [(0, 0.73), (2, 0.53)])
def test_rps_known(spark, index, want):
    assert one(spark, sc.rps(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), F.lit(index))) == pytest.approx(want)


def test_rps_of_two_categories_is_brier(spark):
    for p, y in [(0.3, 1.0), (0.9, 0.0)]:
        rps = one(spark, sc.rps(F.array(F.lit(1 - p), F.lit(p)), F.lit(int(y))))
        assert rps == pytest.approx(one(spark, sc.brier(F.lit(p), F.lit(y))))


def test_brier_refuses_other_outcomes(spark):
    with pytest.raises(Exception, match="0 or 1"):
        one(spark, sc.brier(F.lit(0.2), F.lit(0.5)))


def test_prob_above_is_interp(spark):
    v = np.array([-3, -2, -1, -1, 0.5, 1, 2, 2, 2, 4, 6.0])
    for t in (-9, -3, -1, 0, 0.5, 2, 3.3, 6, 8):
        want = 1 - np.interp(t, v, sc.QUANTILE_LEVELS, left=0.0, right=1.0)
        assert one(spark, sc.prob_above(payload(v), F.lit(float(t)))) == pytest.approx(want), t


def test_grid_contract(spark):
    good = payload(range(11))
    assert one(spark, sc.quantile_grid_issues(good, F.lit(5.0))) == []
    assert one(spark, sc.quantile_grid_issues(good, F.lit(5.1))) == ["point_is_median"]
    assert "non_decreasing" in one(spark, sc.quantile_grid_issues(payload([1, 0, *range(2, 11)]), F.lit(5.0)))
    assert "no_missing_levels" in one(spark, sc.quantile_grid_issues(payload(range(10)), F.lit(5.0)))


def test_distribution_contract_and_renormalisation(spark):
    m = lambda *p: F.map_from_arrays(F.array(*[F.lit(c) for c in "abc"[: len(p)]]), F.array(*[F.lit(float(x)) for x in p]))
    assert one(spark, sc.distribution_issues(m(0.5, 0.5))) == []
    assert one(spark, sc.distribution_issues(m(0.5, 0.6))) == ["sums_to_one"]
    assert one(spark, sc.renormalised(m(0.52, 0.5)))["a"] == pytest.approx(0.52 / 1.02)
    assert one(spark, sc.renormalised(m(0.5, 0.6))) is None


def test_argmax_first_wins_and_category_match(spark):
    cats = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(v)).alias("value")) for k, v in [("cut", -1), ("hold", 0), ("hike", 1)]])
    probs = F.map_from_arrays(F.array(F.lit("hike"), F.lit("cut"), F.lit("hold")), F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))
    assert one(spark, sc.argmax_label(probs, cats)) == "cut"
    assert one(spark, sc.category_index(cats, F.lit(1.0 + 1e-10))) == 2
    assert one(spark, sc.category_index(cats, F.lit(0.5))) is None


def test_intervals_and_string_levels(spark):
    q = F.transform(payload(range(11)), lambda s: F.struct(s["q"].cast("string").cast("double").alias("q"), s["v"]))
    i80 = one(spark, sc.central_interval(q, 0.80))
    assert (i80.lo, i80.hi) == (1.0, 9.0)


def test_normal_cdf(spark):
    for x in (-7.5, -3.0, -0.1, 0.0, 0.7, 2.5, 6.0):
        assert one(spark, stats.normal_cdf(F.lit(x))) == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-12)


@pytest.mark.parametrize("hits,s,c,m", [(6, 10, 10, 8), (0, 10, 10, 3), (3, 5, 200, 40), (11, 120, 118, 11), (0, 4, 4, 0)])
def test_fisher_against_integers(spark, hits, s, c, m):
    want = sum(math.comb(s, k) * math.comb(c, m - k) for k in range(hits, m + 1)) / math.comb(s + c, m)
    cols = [F.lit(v).cast("long") for v in (hits, s, c, m)]
    assert one(spark, stats.fisher_greater(*cols)) == pytest.approx(want, rel=1e-9)


def test_lift_identities(spark):
    lift = lambda b: one(spark, stats.population_lift(F.lit(0.6), F.lit(0.2), F.lit(b)))
    assert lift(0.5) * 0.5 == pytest.approx(0.75)
    assert lift(0.12) == pytest.approx(0.6 / (0.6 * 0.12 + 0.2 * 0.88))
    assert one(spark, stats.population_lift(F.lit(0.0), F.lit(0.0), F.lit(0.1))) is None
