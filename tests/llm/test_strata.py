"""Thresholds of a stratum do not depend on the rest of the corpus."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules


@pytest.mark.parametrize("others", [1_000, 100_000_000])
def test_a_stratum_keeps_its_fences_in_a_larger_table(spark, others):
    counts = [("en", "tail", 400_000, 150), ("en", "bulk", 0, others), ("en", "few", 400_000, 99)]
    metrics = list(quality_rules.metrics())
    sketch = spark.createDataFrame([(lang, s, m, b if m == "symbol_share" else 4_000, n) for lang, s, b, n in counts for m in metrics], "lang string, source string, metric string, bucket long, n long")
    fence = quality_rules.fences(sketch)
    assert {(r.level, r.source) for r in fence.collect()} == {(2, "tail"), (2, "bulk"), (1, ""), (0, "")}
    words = lambda s: ("en", s, 100, 400, 160, 10, 0, 0)
    stats = spark.createDataFrame([words("tail"), words("bulk"), words("few"), words("new")], "lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.STATS))
    assert {r.source: r.kept for r in quality_rules.verdicts(stats, fence).collect()} == {"tail": True, "bulk": False, "few": False, "new": False}


def test_no_broadcast_of_fences(spark):
    stats = spark.range(2_000).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), *[F.lit(100).cast("long").alias(c) for c in quality_rules.STATS])
    plan = quality_rules.verdicts(stats, quality_rules.fences(quality_rules.sketches(stats)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
