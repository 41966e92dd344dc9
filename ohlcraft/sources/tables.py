"""Bars from the driver tables: resampling of ticks to OHLCV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import DAY_MS, HOUR_MS, WEEK_MS, number_bars
from .store import settled, stored

# 1970-01-05 was a Monday, so weekly bars are shifted by four days.
MONDAY_MS = 4 * DAY_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def bucket(ms: Column, every_ms: int, shift_ms: int = 0) -> Column:
    """Left edge of the ``[left, left + every)`` bucket."""
    return (F.floor((ms - shift_ms) / every_ms) * every_ms + shift_ms).cast("long")


def ohlcv_ticks(ticks: DataFrame, symbol: Column, ms: Column, price: Column, size: Column, every_ms: int,
                order: list[Column], shift_ms: int = 0) -> DataFrame:
    """Ticks to bars in one aggregation; partial results are combined before the shuffle."""
    first = F.struct(*order)
    return (
        ticks.select(
            symbol.alias("symbol"), bucket(ms, every_ms, shift_ms).alias("ts"),
            price.cast("double").alias("_p"), size.cast("double").alias("_v"), first.alias("_o"),
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
            F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume"), F.count(F.lit(1)).alias("n_bars"),
        )
    )


def event_bars(spark: SparkSession, sf_dir: str, every_ms: int = HOUR_MS) -> DataFrame:
    """``events``: one symbol per event type, price = value, volume = ticks."""
    e = table(spark, sf_dir, "events")
    return ohlcv_ticks(e, F.col("event_type"), epoch_ms(F.col("ts")), F.col("value"), F.lit(1.0), every_ms,
                       [F.col("ts"), F.col("event_id")]).drop("n_bars")


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` by user and day: many short symbols."""
    e = table(spark, sf_dir, "events")
    return ohlcv_ticks(e, F.col("user_id"), epoch_ms(F.col("ts")), F.col("value"), F.lit(1.0), DAY_MS,
                       [F.col("ts"), F.col("event_id")]).drop("n_bars")


def brand_bars(spark: SparkSession, sf_dir: str, every_ms: int = WEEK_MS) -> DataFrame:
    """``lineitem`` joined to ``part``: one symbol per brand, price per unit.

    Sums and extremes come from one hash aggregation by brand and date that also keeps the first and the last order of a date. Only the lines
    of a bar's first and last order are then sorted for its open and close, so no task sorts the table.
    """
    # joined by a hash table of a share of the parts: a merge would sort the lines
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol")).hint("shuffle_hash")
    shift = MONDAY_MS if every_ms == WEEK_MS else 0
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "ts": bucket(epoch_ms(F.col("l_shipdate")), every_ms, shift), "_p": F.col("l_extendedprice") / F.col("l_quantity")})

    def branded(some: DataFrame) -> DataFrame:
        return some.join(part, F.col("l_partkey") == F.col("p_partkey"))

    dates = branded(lines).groupBy("symbol", "ts", "l_shipdate").agg(
        F.max("_p").alias("high"), F.min("_p").alias("low"), F.sum("l_quantity").alias("volume"),
        F.min("l_orderkey").alias("_a"), F.max("l_orderkey").alias("_z"))
    whole = settled(dates.groupBy("symbol", "ts").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").cast("double").alias("volume"),
        F.min(F.struct(F.col("l_shipdate").alias("day"), F.col("_a").alias("order"))).alias("_first"),
        F.max(F.struct(F.col("l_shipdate").alias("day"), F.col("_z").alias("order"))).alias("_last")))
    ends = whole.select(F.explode(F.array("_first", "_last")).alias("_e")).select("_e.*").distinct()
    # two orders per brand and period, whatever the number of lines
    near = lines.join(F.broadcast(ends), F.col("l_shipdate").eqNullSafe(F.col("day")) & F.col("l_orderkey").eqNullSafe(F.col("order")), "left_semi")
    rank = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    found = branded(near).groupBy("symbol", "ts", F.struct(F.col("l_shipdate").alias("day"), F.col("l_orderkey").alias("order")).alias("_e")).agg(
        F.min_by("_p", rank).alias("open"), F.max_by("_p", rank).alias("close")).withColumnsRenamed({"symbol": "_symbol", "ts": "_ts"})
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("ts").eqNullSafe(F.col("_ts"))
    out = whole
    for end, x in (("_first", "open"), ("_last", "close")):
        out = out.join(found.select("_symbol", "_ts", "_e", x), same & F.col(end).eqNullSafe(F.col("_e")), "left").drop("_symbol", "_ts", "_e")
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume")


def bars(spark: SparkSession, sf_dir: str, every_ms: int = HOUR_MS) -> DataFrame:
    """Numbered event bars, stored once."""
    return stored(spark, f"bars_{every_ms}", sf_dir, lambda: number_bars(event_bars(spark, sf_dir, every_ms), every_ms))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered daily bars per user, stored once."""
    return stored(spark, "user_bars", sf_dir, lambda: number_bars(user_bars(spark, sf_dir), DAY_MS))


def brands(spark: SparkSession, sf_dir: str, every_ms: int = WEEK_MS) -> DataFrame:
    """Numbered bars per brand, stored once."""
    return stored(
        spark, f"brand_bars_{every_ms}", sf_dir, lambda: number_bars(brand_bars(spark, sf_dir, every_ms), every_ms)
    )
