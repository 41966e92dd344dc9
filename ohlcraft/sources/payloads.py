"""Typed tables from landed exchange payloads and mixed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KLINE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume")],
    T.StructField("close_time", T.LongType()), T.StructField("quote_volume", T.DoubleType()),
    T.StructField("n_trades", T.LongType()), T.StructField("taker_buy_volume", T.DoubleType()),
])


def klines(raw: DataFrame, now_ms: int | Column) -> DataFrame:
    """Kline arrays of strings (column ``row``) to typed bars; the bar still open is dropped."""
    r = F.col("row")
    out = raw.select(
        "symbol", r[0].cast("long").alias("ts"),
        *[r[i + 1].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))],
        r[6].cast("long").alias("close_time"), r[7].cast("double").alias("quote_volume"),
        r[8].cast("long").alias("n_trades"), r[9].cast("double").alias("taker_buy_volume"),
    )
    return out.filter(F.col("close_time") <= now_ms)


def candles(raw: DataFrame) -> DataFrame:
    """Candle arrays with a confirmation flag in position 8; unconfirmed ones are skipped."""
    r = F.col("row")
    return raw.filter(r[8] == "1").select(
        "symbol", r[0].cast("long").alias("ts"),
        *[r[i + 1].cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))],
    )


def rates(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Funding payloads ``{"fundingTime": …, "fundingRate": …}`` to ``(symbol, ts, rate)``."""
    p = F.from_json(payload, "fundingTime string, fundingRate string")
    return raw.select("symbol", p["fundingTime"].cast("long").alias("ts"), p["fundingRate"].cast("double").alias("rate"))


def open_interest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    p = F.from_json(payload, "timestamp string, sumOpenInterest string, sumOpenInterestValue string")
    return raw.select("symbol", p["timestamp"].cast("long").alias("ts"), p["sumOpenInterest"].cast("double").alias("oi"),
                      p["sumOpenInterestValue"].cast("double").alias("oi_quote"))


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """A bar table partitioned by symbol; the filter prunes folders, the columns prune the scan."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    return df.select(*cols) if cols else df


def write_bars(df: DataFrame, path: str, by: list[str], mode: str = "overwrite", hot_rows: int = 1_000_000) -> None:
    """Write partitioned by ``by``; a hot value spreads over many files."""
    df.write.mode(mode).option("maxRecordsPerFile", hot_rows).partitionBy(*by).parquet(path)


def read_csv_bars(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def split_adjusted(df: DataFrame) -> DataFrame:
    """Scale open, high and low by ``closeadj / closeunadj`` and take the adjusted close."""
    k = F.try_divide("closeadj", "closeunadj")
    return df.withColumns({c: F.col(c) * k for c in ("open", "high", "low")}).withColumn("close", F.col("closeadj"))


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns missing in an older file, or NULL, take their default."""
    cols = {}
    for name, (kind, value) in defaults.items():
        filler = F.lit(value).cast(kind)
        cols[name] = F.coalesce(F.col(name).cast(kind), filler) if name in df.columns else filler
    return df.withColumns(cols)


def epoch_to_ms(df: DataFrame, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Seconds become milliseconds when the largest stamp of the source says so."""
    by = by or []
    top = df.groupBy(*by).agg(F.max(ts).alias("_top"))
    joined = df.join(top, by) if by else df.crossJoin(F.broadcast(top))
    return joined.withColumn(ts, F.when(F.col("_top") < 10**11, F.col(ts) * 1000).otherwise(F.col(ts))).drop("_top")


def high_water(df: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Where an incremental load resumes (newest) and backfills (oldest)."""
    return df.groupBy(key).agg(F.min(ts).alias("oldest"), F.max(ts).alias("newest"), F.count(F.lit(1)).alias("n"))


def increment(landed: DataFrame, stored: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Landed rows outside the stored range of their symbol."""
    marks = high_water(stored, key, ts).select(key, "oldest", "newest")
    out = landed.join(marks, key, "left")
    fresh = F.col("newest").isNull() | (F.col(ts) > F.col("newest")) | (F.col(ts) < F.col("oldest"))
    return out.filter(fresh).drop("oldest", "newest")
