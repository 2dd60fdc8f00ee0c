"""Run numbers under callers at the same time, failed runs and ledgers written before there were claims."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from test_forecast import monthly_ramp, task_and_spec
from tidemark.operators import forecast as fc
from tidemark.plans import backtest as bt


def test_one_budget_many_callers(spark, tmp_path):
    def call(_):
        return bt.RunClaims(spark, str(tmp_path / "ledger")).take("a/b ../c", 5)

    with ThreadPoolExecutor(12) as pool:
        got = list(pool.map(call, range(24)))
    assert sorted(n for n in got if n is not None) == [1, 2, 3, 4, 5] and got.count(None) == 19


def test_failed_runs_give_their_place_back(spark, tmp_path):
    claims = bt.RunClaims(spark, str(tmp_path / "ledger"))
    assert claims.take("s", 1) == 1
    claims.fail("s", 1)
    claims.fail("s", 1)  # told twice
    assert claims.take("s", 1) == 2 and claims.take("s", 1) is None
    assert claims.take("free", None) == 1 and claims.take("free", None) == 2
    assert claims.take("old", 3, recorded=2) == 3 and claims.take("old", 3, recorded=2) is None


def test_a_failed_run_is_told_apart(spark, tmp_path):
    obs = monthly_ramp(spark)
    t, s = task_and_spec(spark, "ramp", max_runs=1)
    path = str(tmp_path / "ledger")

    def broken(ctx, observations):
        # fails when the plan runs, after evaluate could have returned it
        return fc.last_value(ctx, observations).withColumn("point", F.raise_error(F.lit("no such model")).cast("double"))

    with pytest.raises(Exception, match="no such model"):
        bt.evaluate(spark, obs, t, s, {"n": broken}, path)
    assert bt.runs_per_spec(s, spark.read.parquet(path)).first().runs_left == 1
    assert bt.evaluate(spark, obs, t, s, {"n": fc.last_value}, path).first().run_number == 2
    with pytest.raises(RuntimeError, match="budget"):
        bt.evaluate(spark, obs, t, s, {"n": fc.last_value}, path)
    assert sorted((r.run_number, r.status) for r in spark.read.parquet(path).collect()) == [(1, "failed"), (2, "done")]
    assert bt.runs_per_spec(s, spark.read.parquet(path)).first().runs_left == 0


def test_ledger_without_status(spark, tmp_path):
    obs, path = monthly_ramp(spark), str(tmp_path / "ledger")
    t, s = task_and_spec(spark, "ramp", max_runs=2)
    spark.range(1).select(F.lit("spec").alias("spec_id"), F.current_timestamp().cast("timestamp_ntz").alias("ran_at"), F.lit(1).cast("long").alias("run_number")).write.parquet(path)
    assert bt.evaluate(spark, obs, t, s, {"n": fc.last_value}, path).first().run_number == 2
    with pytest.raises(RuntimeError, match="budget"):
        bt.evaluate(spark, obs, t, s, {"n": fc.last_value}, path)
