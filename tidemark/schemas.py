"""Table schemas.  One long table per concept; never one DataFrame per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

NTZ = T.TimestampNTZType()

OBSERVATIONS = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("timestamp", NTZ, False),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("released_at", NTZ, True),
    ]
)

SERIES_META = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("units", T.StringType(), True),
        T.StructField("frequency", T.StringType(), True),
        T.StructField("table_id", T.StringType(), True),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("publication_date", T.DateType(), False),
        T.StructField("title", T.StringType(), True),
        T.StructField("lang", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("page_count", T.IntegerType(), True),
        T.StructField("n_chars", T.LongType(), True),
        T.StructField("est_tokens", T.LongType(), True),
        T.StructField("extracted_at", NTZ, True),
    ]
)

CATEGORY = T.StructType(
    [T.StructField("label", T.StringType(), False), T.StructField("value", T.DoubleType(), False)]
)

TASKS = T.StructType(
    [
        T.StructField("task_id", T.StringType(), False),
        T.StructField("target_series_id", T.StringType(), False),
        T.StructField("horizons", T.ArrayType(T.IntegerType()), False),
        T.StructField("frequency", T.StringType(), False),
        T.StructField("payload_type", T.StringType(), False),
        T.StructField("categories", T.ArrayType(CATEGORY), True),
        # Declared by the data model, ignored by the harness: only exact-timestamp resolution exists.
        T.StructField("resolution_fn", T.StringType(), True),
    ]
)

SPECS = T.StructType(
    [
        T.StructField("spec_id", T.StringType(), False),
        T.StructField("task_id", T.StringType(), False),
        T.StructField("start", NTZ, False),
        T.StructField("end", NTZ, False),
        T.StructField("stride", T.IntegerType(), False),
        T.StructField("warmup", T.IntegerType(), False),
        T.StructField("max_runs", T.IntegerType(), True),
        T.StructField("origin_dates", T.ArrayType(NTZ), True),
    ]
)

QUANTILE = T.StructType([T.StructField("q", T.DoubleType()), T.StructField("v", T.DoubleType())])

PREDICTIONS = T.StructType(
    [
        T.StructField("spec_id", T.StringType(), False),
        T.StructField("predictor_id", T.StringType(), False),
        T.StructField("task_id", T.StringType(), False),
        T.StructField("as_of", NTZ, False),
        T.StructField("horizon", T.IntegerType(), True),
        T.StructField("forecast_date", NTZ, False),
        T.StructField("payload_type", T.StringType(), False),
        T.StructField("point", T.DoubleType(), True),
        T.StructField("quantiles", T.ArrayType(QUANTILE), True),
        T.StructField("probability", T.DoubleType(), True),
        T.StructField("probs", T.MapType(T.StringType(), T.DoubleType()), True),
        T.StructField("metadata", T.StringType(), True),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to ``schema``, adding missing nullable columns as nulls.

    A missing required column is an error, as it is when a series is registered.
    """
    have = set(df.columns)
    missing = [f.name for f in schema if f.name not in have and not f.nullable]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
