"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ohlcraft.queries import load
from ohlcraft.session import build

HEADLINE = [
    "bars_1h", "bars_users", "resample_1d", "asof_higher_timeframe", "sma", "ema", "rsi", "macd", "atr", "cdl_engulfing",
    "cdl_all_counts", "scrsi", "supertrend", "barrier_outcome", "cross_trades", "average_cross_report", "accrual_stream",
    "nw_sharpe", "max_drawdown", "block_bootstrap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", master=f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
