"""Bars of a longer duration from shorter ones, with the time they become known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import MONDAY_MS, bucket
from .frames import KEY, WEEK_MS

# fixed values: bar codes and their durations in minutes
BAR_MINUTES = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "12h": 720,
               "1d": 1440, "1w": 10080}


def duration_ms(bar: str) -> int:
    if bar not in BAR_MINUTES:
        raise ValueError(f"unsupported bar {bar!r}, expected one of {sorted(BAR_MINUTES)}")
    return BAR_MINUTES[bar] * 60_000


def resample(bars: DataFrame, target_ms: int, base_ms: int, drop_partial: bool = True, key: str = KEY) -> DataFrame:
    """Left-closed, left-labelled bars; one that could still grow is dropped.

    ``known_ts`` is when the bar has closed: the earliest time its values may be used.
    """
    shift = MONDAY_MS if target_ms == WEEK_MS else 0
    out = bars.groupBy(key, bucket(F.col("ts"), target_ms, shift).alias("_b")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"),
        F.max("ts").alias("_last"),
    ).withColumnRenamed("_b", "ts")
    out = out.withColumn("known_ts", F.col("ts") + target_ms)
    if drop_partial:
        end = bars.groupBy(key).agg((F.max("ts") + base_ms).alias("_end"))
        out = out.join(end, key).filter(F.col("known_ts") <= F.col("_end")).drop("_end")
    return out.drop("_last")


def bucket_bars(bars: DataFrame, every_ms: int, key: str = KEY) -> DataFrame:
    """Buckets ``ts // every``: the stamp is that of the first bar in it, partial ones stay."""
    return bars.groupBy(key, F.floor(F.col("ts") / every_ms).alias("bucket")).agg(
        F.min("ts").alias("ts"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )


def closes(bars: DataFrame, every_ms: int, key: str = KEY) -> DataFrame:
    return bars.groupBy(key, F.floor(F.col("ts") / every_ms).alias("bucket")).agg(F.max_by("close", "ts").alias("close"))


def dense_grid(rows: DataFrame, col: str, step: int, key: str = KEY) -> DataFrame:
    """Every slot between a key's first and last one.

    The range is first cut into pieces of 1024 slots, so a long history is expanded by
    many tasks.
    """
    piece = 1024 * step
    ends = rows.groupBy(key).agg(F.min(col).alias("_a"), F.max(col).alias("_b"))
    pieces = ends.withColumn("_p", F.explode(F.sequence(F.col("_a"), F.col("_b"), F.lit(piece)))).repartition(key, "_p")
    return pieces.select(key, F.explode(F.sequence("_p", F.least(F.col("_p") + piece - step, F.col("_b")), F.lit(step))).alias(col))


def common_buckets(rows: DataFrame, bucket_col: str, key: str = KEY) -> DataFrame:
    """Rows in buckets where every key is present."""
    keys = rows.select(key).distinct().agg(F.count(F.lit(1)).alias("_all"))
    full = rows.groupBy(bucket_col).agg(F.countDistinct(key).alias("_n")).crossJoin(F.broadcast(keys)).filter("_n = _all")
    return rows.join(full.select(bucket_col), bucket_col, "left_semi")
