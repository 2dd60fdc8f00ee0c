"""Small hand-made inputs."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

OBS = "series_id string, timestamp timestamp_ntz, value double, released_at timestamp_ntz"


def ts(text):
    return dt.datetime.fromisoformat(text)


def observations(spark, rows):
    """rows: (series, stamp, value, release or None) with ISO text stamps."""
    return spark.createDataFrame([(s, ts(t), float(v), ts(r) if r else None) for s, t, v, r in rows], OBS)


def price_path(spark, returns_pct, series="p", start="2024-01-01"):
    """Business-day prices 100 * cumprod(1 + r / 100), released the next business day."""
    days = pd.bdate_range(start, periods=len(returns_pct) + 1)
    values = 100 * np.cumprod(np.r_[1.0, 1 + np.array(returns_pct) / 100])
    rel = days + pd.offsets.BDay(1)
    rows = [(series, d.to_pydatetime(), float(v), r.to_pydatetime()) for d, v, r in zip(days, values, rel)]
    return spark.createDataFrame(rows, OBS)


def quantile_struct(spark_df, point="point", spread=5.0):
    from tidemark.functions import scoring as sc

    return spark_df.withColumn("quantiles", sc.quantiles_of(lambda q: F.col(point) + F.lit((q - 0.5) * spread)))
