"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm the JVM-wide code caches of its stages, then once timed with
its result written to the no-op sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark import queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "backtest_summary", "leaderboard", "visible_state", "trailing_visible", "log_returns", "business_daily_fill", "interpolated_grid",
    "cumulative_returns", "release_driven_expansion", "log_random_walk_forecasts", "historical_frequency", "rps_backtest", "error_report",
    "paired_test", "direction_metrics", "shock_windows", "control_candidates", "volatility_regimes", "pattern_evidence", "anchor_table",
    "macro_features", "lagged_regression", "date_fence", "page_text", "calendar_distances", "ohlcv_fields",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    run = queries.queries()
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem", "events", "documents", "pages")}
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            t0 = time.perf_counter()
            run[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "tidemark_headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "input_rows": rows,
                "rows_per_sec": {"calendar_distances": round(rows["lineitem"] / times["calendar_distances"]), "date_fence": round(rows["documents"] / times["date_fence"])},
            }
        )
    )


if __name__ == "__main__":
    main()
