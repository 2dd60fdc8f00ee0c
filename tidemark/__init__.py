"""tidemark: point-in-time series analytics, forecast scoring and event studies on Spark.

Everything is a function from DataFrames to DataFrames over a handful of long
tables (see :mod:`tidemark.schemas`).  The name is the idea: a tidemark shows how
far the water had come at one moment, and every result here is computed from
what had been released by one moment.
"""
