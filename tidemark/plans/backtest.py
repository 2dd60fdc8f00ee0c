"""Backtests as one plan: origins, warm-up, forecasts, resolution, scores, summary, stored results."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors.exceptions.captured import UnknownException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import calendar as cal, scoring as sc
from tidemark.operators import asof
from tidemark.operators import forecast as fc
from tidemark.session import settled

log = logging.getLogger(__name__)

Forecaster = Callable[[DataFrame, DataFrame], DataFrame]
RESULT_KEY = ["spec_id", "predictor_id", "task_id"]
NOT_RUN = ("failed", "refused")


def origin_table(tasks: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per spec, task and origin.  Specs name their task, so no table is crossed."""
    named = tasks.withColumn("series_id", F.col("target_series_id")).select(
        "task_id", "series_id", "horizons", "frequency", "payload_type", "categories"
    )
    return cal.origins(specs.join(named, "task_id")).drop("start", "end", "stride", "max_runs")


def mixed_frequency_specs(tasks: DataFrame, specs: DataFrame) -> DataFrame:
    """Specs whose tasks do not share one frequency (not allowed)."""
    both = specs.join(tasks.select("task_id", "frequency"), "task_id")
    return both.groupBy("spec_id").agg(F.size(F.collect_set("frequency")).alias("n_frequencies")).filter("n_frequencies > 1")


def warmed_up(ctx: DataFrame) -> DataFrame:
    """Origins with enough visible target rows to forecast from."""
    return ctx.filter(F.col("n_visible") >= F.col("warmup"))


def resolve(predictions: DataFrame, observations: DataFrame, now: Column | None = None, *, keep_unresolved: bool = False) -> DataFrame:
    """Attach the value observed at exactly the forecast date.

    One equi-join on ``(series_id, timestamp)``; a prediction whose date has no row is
    dropped, or kept with a null ``actual`` on request.  ``now`` bounds what counts as
    released (default: everything in the table).
    """
    seen = observations if now is None else observations.filter(asof.released() <= now)
    actual = (
        seen.groupBy("series_id", F.col("timestamp").alias("forecast_date"))
        .agg(F.min_by("value", asof.released()).alias("actual"))
    )
    return predictions.join(actual, ["series_id", "forecast_date"], "left" if keep_unresolved else "inner")


def score_predictions(resolved: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    df = resolved
    if "categories" not in df.columns:
        df = df.join(tasks.select("task_id", "categories"), "task_id") if tasks is not None else df.withColumn(
            "categories", F.lit(None).cast("array<struct<label:string,value:double>>")
        )
    return df.withColumn("metric", sc.metric_name(F.col("payload_type"))).withColumn("score", sc.score(F.col("actual")))


def summarise(scored: DataFrame, origins: DataFrame) -> DataFrame:
    """Mean score, scored predictions and skipped origins per spec, predictor and task.

    An origin is skipped when none of its predictions scored.  Origins are counted, not
    collected: the distinct pass partially aggregates before its shuffle.
    """
    per_origin = scored.groupBy(*RESULT_KEY, "metric", "as_of").agg(F.sum("score").alias("_s"), F.count("score").alias("_n"))
    done = per_origin.groupBy(*RESULT_KEY, "metric").agg(
        (F.sum("_s") / F.sum("_n")).alias("mean_score"),
        F.sum("_n").alias("n_scored"),
        F.count(F.lit(1)).alias("_done"),
    )
    asked = origins.groupBy("spec_id", "task_id").agg(F.count(F.lit(1)).alias("_asked"))
    joined = done.join(asked, ["spec_id", "task_id"])
    return joined.withColumn("n_skipped_origins", F.col("_asked") - F.col("_done")).drop("_asked", "_done")


def require_scored(summary: DataFrame, origins: DataFrame, predictor_ids: list[str]) -> None:
    """Raise when some requested (spec, task) scored nothing for a predictor."""
    wanted = origins.select("spec_id", "task_id").distinct().withColumn(
        "predictor_id", F.explode(F.array(*[F.lit(p) for p in predictor_ids]))
    )
    lost = wanted.join(summary, RESULT_KEY, "left_anti").limit(5).collect()
    if lost:
        raise RuntimeError(f"every origin was skipped for {[tuple(r) for r in lost]}")


def forecast_all(origins: DataFrame, observations: DataFrame, forecasters: dict[str, Forecaster]) -> DataFrame:
    """Context once, then every forecaster on the warmed-up origins."""
    ctx = warmed_up(fc.context(origins, observations))
    out = None
    for forecaster in forecasters.values():
        part = forecaster(ctx, observations)
        out = part if out is None else out.unionByName(part)
    return out


def backtest(
    observations: DataFrame, tasks: DataFrame, specs: DataFrame, forecasters: dict[str, Forecaster], now: Column | None = None
) -> DataFrame:
    """Scored predictions of all specs, tasks, origins, horizons and forecasters."""
    origins = origin_table(tasks, specs)
    resolved = resolve(forecast_all(origins, observations, forecasters), observations, now)
    return score_predictions(resolved, tasks)


# --- stored results ------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def save_results(scored: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Store scored rows, one folder per spec and predictor, rows clustered by task.

    A folder per task would be millions of tiny files; task ids are sorted inside the
    files instead, so a task filter skips row groups.
    """
    writer = scored.sortWithinPartitions("spec_id", "predictor_id", "task_id").write
    if overwrite:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.partitionBy("spec_id", "predictor_id").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Every stored result under ``path`` (partitions discovered), or None when nothing is stored."""
    return spark.read.parquet(path) if _exists(spark, path) else None


def missing_tasks(requested: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Requested ``spec_id, predictor_id, task_id`` without a stored row."""
    return requested if stored is None else requested.join(stored.select(*RESULT_KEY).distinct(), RESULT_KEY, "left_anti")


def cached_backtest(
    spark: SparkSession, observations: DataFrame, tasks: DataFrame, specs: DataFrame,
    forecasters: dict[str, Forecaster], path: str, *, force_refresh: bool = False,
) -> DataFrame:
    """Load stored tasks, compute only the others, append them, and return everything asked for.

    A forecaster that fails is logged and left out; the others are kept.  A failure of the cluster (a lost executor,
    a broken gateway) is not the forecaster's and is raised.
    """
    asked = specs.select("spec_id", "task_id").distinct()
    for name, forecaster in forecasters.items():
        stored = None if force_refresh else load_results(spark, path)
        todo = missing_tasks(asked.withColumn("predictor_id", F.lit(name)), stored)
        rest = specs.join(todo.select("spec_id", "task_id"), ["spec_id", "task_id"], "left_semi")
        if rest.isEmpty():
            continue
        try:
            fresh = backtest(observations, tasks, rest, {name: forecaster})
            if force_refresh and (old := load_results(spark, path)) is not None:
                # partitions are replaced as wholes, so the tasks in them that are not refreshed go in again
                touched = rest.select("spec_id").distinct()
                others = old.where(F.col("predictor_id") == name).join(touched, "spec_id", "left_semi").join(todo.select("spec_id", "task_id"), ["spec_id", "task_id"], "left_anti")
                fresh = settled(fresh.unionByName(others.select(*fresh.columns)), "refreshed")
            save_results(fresh, path, overwrite=force_refresh)
        except (Py4JError, UnknownException):
            raise
        except Exception as error:  # noqa: BLE001 - one failing model must not lose the others
            log.warning("forecaster %s failed: %s", name, error)
    stored = load_results(spark, path)
    if stored is None:
        raise RuntimeError("no forecaster produced a result")
    return stored.join(asked, ["spec_id", "task_id"], "left_semi").filter(F.col("predictor_id").isin(*forecasters))


# --- run ledger -------------------------------------------------------------------------


def runs_per_spec(specs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs used and left per spec (``runs_left`` null = unlimited).  Runs that failed, or whose call was refused for another spec, do not count."""
    counted = ledger.filter(~F.coalesce(F.col("status").isin(*NOT_RUN), F.lit(False))) if "status" in ledger.columns else ledger
    used = counted.groupBy("spec_id").agg(F.count(F.lit(1)).alias("_used"))
    limits = specs.groupBy("spec_id").agg(F.max("max_runs").alias("max_runs"))
    out = limits.join(used, "spec_id", "left").withColumn("runs_used", F.coalesce("_used", F.lit(0).cast("long"))).drop("_used")
    return out.withColumn("runs_left", F.greatest(F.col("max_runs") - F.col("runs_used"), F.lit(0).cast("long")))


class RunClaims:
    """Run numbers of specs, claimed by creating a marker that must not exist yet.

    A claim is taken before the work, so two callers cannot spend one run; it stays taken if its caller dies, since what that
    caller has seen is not known.  A run that reports its failure gives its place back under a later number.  Numbers
    have no gaps.  The folder's file system must create files atomically: of two creators one must fail (HDFS and local or
    mounted folders do; object stores without conditional writes do not).
    """

    def __init__(self, spark: SparkSession, ledger_path: str):
        self._jvm, self._root = spark._jvm, f"{ledger_path.rstrip('/')}_claims"
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self._root, *[p for p in parts if p]]))

    def _folder(self, spec_id: str) -> str:
        return f"spec={quote(spec_id, safe='')}"

    def _state(self, spec_id: str, recorded: int) -> tuple[int, int]:
        """The next number and how many runs have failed.  Runs ``recorded`` before there were markers count too."""
        path = self._path(self._folder(spec_id))
        names = [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
        taken = [int(n.split(".")[0]) for n in names if n.endswith(".run")]
        return max([recorded, *taken]) + 1, sum(n.endswith(".failed") for n in names)

    def _create(self, spec_id: str, name: str) -> bool:
        """False where the marker is there already."""
        folder = self._path(self._folder(spec_id))
        self._fs.mkdirs(folder)
        path = self._fs.makeQualified(self._path(self._folder(spec_id), name))
        if path.toUri().getScheme() == "file":
            # Hadoop's local file system looks first and creates after; the system call does both at once
            try:
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError:
            if self._fs.exists(path):
                return False
            raise
        return True

    def take(self, spec_id: str, max_runs: int | None, recorded: int = 0) -> int | None:
        """The claimed run number, or None where the budget is used up."""
        while True:
            number, failed = self._state(spec_id, recorded)
            if max_runs is not None and number - failed > max_runs:
                return None
            if self._create(spec_id, f"{number}.run"):
                return number

    def fail(self, spec_id: str, number: int) -> None:
        self._create(spec_id, f"{number}.failed")


def evaluate(
    spark: SparkSession, observations: DataFrame, tasks: DataFrame, specs: DataFrame,
    forecasters: dict[str, Forecaster], ledger_path: str,
) -> DataFrame:
    """A budgeted run: claim a run of every spec, score, then record the run as done; refuse where a spec has none left.

    The scores are written out before the run is recorded, so a run that the ledger calls done has been computed.  A run that raises is
    recorded as failed, with its number, and does not count.  The specs of a call are configuration and read by the driver.
    """
    # older ledgers have no status
    ledger = spark.read.option("mergeSchema", True).parquet(ledger_path) if _exists(spark, ledger_path) else None
    limits = {r["spec_id"]: r["max_runs"] for r in specs.groupBy("spec_id").agg(F.max("max_runs").alias("max_runs")).collect()}
    before = {r["spec_id"]: r["n"] for r in ledger.groupBy("spec_id").agg(F.max("run_number").alias("n")).collect()} if ledger is not None else {}
    claims, held = RunClaims(spark, ledger_path), {}
    for spec_id in sorted(limits):
        number = claims.take(spec_id, limits[spec_id], before.get(spec_id) or 0)
        if number is None:
            _record(spark, claims, held, "refused", ledger_path)
            raise RuntimeError(f"run budget used up for {spec_id!r}")
        held[spec_id] = number
    try:
        scored = settled(backtest(observations, tasks, specs, forecasters), "run")
    except BaseException:
        _record(spark, claims, held, "failed", ledger_path)
        raise
    _record(spark, claims, held, "done", ledger_path)
    number = spark.createDataFrame(sorted(held.items()), "spec_id string, run_number long")
    return scored.join(F.broadcast(number), "spec_id")


def _record(spark: SparkSession, claims: RunClaims, held: dict[str, int], status: str, ledger_path: str) -> None:
    if not held:
        return
    if status in NOT_RUN:
        for spec_id, number in held.items():
            claims.fail(spec_id, number)
    rows = spark.createDataFrame([(s, n, status) for s, n in sorted(held.items())], "spec_id string, run_number long, status string")
    entry = rows.select("spec_id", F.current_timestamp().cast("timestamp_ntz").alias("ran_at"), "run_number", "status")
    entry.coalesce(1).write.mode("append").parquet(ledger_path)
