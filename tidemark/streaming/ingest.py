"""Late-released observations as a stream.

Only the landing step streams: new files are canonicalised and appended exactly once.
Lateness needs no watermark here, because a late row is an ordinary row with a late
``released_at`` and every query already reads by release.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.features import canonical
from tidemark.schemas import OBSERVATIONS


def landed(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    return canonical(spark.readStream.format(fmt).schema(OBSERVATIONS).load(folder))


def append(stream: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append to a parquet table; ``once`` drains what has landed and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
