"""Streaming forms: closed bars, deduplicated pages, state per symbol, late resolution of trades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.fold import Kernel

c = F.col


def closed_bars(ticks: DataFrame, every: str, delay: str, price: str = "price", size: str = "size", order: str = "ts") -> DataFrame:
    """Bars that can no longer change: append mode emits a bucket once the watermark has passed its end."""
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", every).alias("w"))
    bars = g.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.sum(size).alias("volume"), F.count(F.lit(1)).alias("n_bars"))
    return bars.select("symbol", F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_bars", F.unix_millis("w.end").alias("known_ts"))


def first_pages(rows: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Overlapping pages keep the first copy of each key; keys older than the delay are forgotten."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stateful(bars: DataFrame, kernel: Kernel, inputs: list[str], outputs: dict[str, str], key: str = "symbol", order: str = "idx") -> DataFrame:
    """The step function of a batch fold, carried as state between micro-batches.

    Bars must arrive in order per symbol (one file or offset range at a time does that).
    """
    key_type = bars.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, {order} long" + "".join(f", {o} {t}" for o, t in outputs.items())

    def step(k, batches, state):
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        opened = list(state.get[0]) if state.exists else None
        made, closed = kernel({x: pdf[x].to_numpy() for x in inputs}, opened)
        state.update((list(map(float, closed)),))
        out = pd.DataFrame({key: pdf[key].to_numpy(), order: pdf[order].to_numpy()})
        for name in outputs:
            out[name] = made[name]
        yield out

    return bars.groupBy(key).applyInPandasWithState(step, schema, "s array<double>", "append", GroupStateTimeout.NoTimeout)


def ema_kernel(n: int) -> Kernel:
    """EMA with the mean of the first n values as seed, as a step function."""
    gain = 2 / (n + 1)

    def run(a, state):
        x, out = a["close"], np.full(len(a["close"]), np.nan)
        seen, total, y = state if state else (0.0, 0.0, np.nan)
        for i, v in enumerate(x):
            seen += 1
            if seen <= n:
                total += v
                y = total / n if seen == n else np.nan
            else:
                y += gain * (v - y)
            out[i] = y
        return {"y": out}, [seen, total, y]

    return run


def resolve(signals: DataFrame, bars: DataFrame, horizon_ms: int, delay: str) -> DataFrame:
    """Join signals with the bars of their horizon; state is dropped when the horizon has passed.

    Both sides carry an event-time column ``at``.
    """
    s = signals.withWatermark("at", delay).alias("s")
    b = bars.withWatermark("at", delay).alias("b")
    span = F.expr(f"interval {horizon_ms} milliseconds")
    return s.join(b, (c("s.symbol") == c("b.symbol")) & (c("b.at") > c("s.at")) & (c("b.at") <= c("s.at") + span))


def parity_sink(expected: DataFrame, keys: list[str], report: str):
    """A ``foreachBatch`` body: rows of the batch that the recorded table does not hold are appended to ``report``."""

    def check(batch: DataFrame, epoch: int) -> None:
        extra = batch.join(expected, keys, "left_anti").withColumn("epoch", F.lit(epoch))
        extra.write.mode("append").parquet(report)

    return check
