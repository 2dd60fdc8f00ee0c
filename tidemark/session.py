"""Session helpers: a local session for tests and the bench, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session with UTC stamps.  On a cluster the job's own session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset on one machine, a temporary one per application."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that jobs run from any working directory and on any executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables written in each open :func:`temporary` block, the outermost first.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside the block go when it ends, but for those settled with ``stay``.

    What leaves the block must not read them any more: settle the result with ``stay``.  The shuffle files of
    a query that ends inside the block go with the query; else they stay until the driver collects garbage, which may
    be after a whole stage.
    """
    own: list[str] = []
    token = _WRITTEN.set((*_WRITTEN.get(), own))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
        _WRITTEN.reset(token)
        for path in own:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def settled(df: DataFrame, name: str = "table", stay: bool = False) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Used where one derived table feeds several branches of a plan: it is computed once,
    its lineage is cut, and a lost executor re-reads files instead of recomputing.  Inside a
    :func:`temporary` block the table goes with the block, or, with ``stay``, with the block around it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    blocks = _WRITTEN.get()[:-1] if stay else _WRITTEN.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows before heavy per-row work when a scan yields fewer partitions than cores.

    A few large row groups would keep most cores idle; a scan of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
