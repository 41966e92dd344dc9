"""Exact quantiles of groups of any size: values are counted, cut into ranges, and only the range that holds a rank is read on.

``F.percentile`` keeps every distinct value of a group in one aggregation buffer. Here equal values are counted first (partly
before the shuffle), the counts are range-partitioned by key and value, one row per key and range tells which range holds
the wanted ranks, and a running count inside that range finds the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, keys: list[str], x: str, shares: list[float]) -> DataFrame:
    """``keys``, ``share`` and ``value``: quantiles with linear interpolation between ranks, nulls ignored.

    Null keys are a group of their own; a group without a value has no row.
    """
    from ..sources.store import settled

    names = [f"_k{i}" for i in range(len(keys))]
    counted = df.filter(F.col(x).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    parted = settled(counted.repartitionByRange(*names, "_x").withColumn("_pid", F.spark_partition_id()))
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    ranges = parted.groupBy(*names, "_pid").agg(F.sum("_n").alias("_rows")).select(
        *names, "_pid", "_rows", F.coalesce(F.sum("_rows").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"))
    asked = ranges.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    place = F.col("share") * (F.col("_total") - 1)
    wanted = asked.withColumns({"_place": place, "_rank": F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))})
    wanted = settled(wanted.filter("_rank >= _before and _rank < _before + _rows"))
    read = _same(parted, wanted.select(*names, "_pid").distinct(), [*names, "_pid"], "left_semi")
    upto = F.sum("_n").over(Window.partitionBy(*names, "_pid").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = read.withColumn("_upto", upto)
    hit = _same(ranked, wanted, [*names, "_pid"], "inner", "_w_").filter("_w__rank - _w__before >= _upto - _n and _w__rank - _w__before < _upto")
    share = F.max(F.col("_w__place") - F.floor("_w__place"))
    out = hit.groupBy(*names, F.col("_w_share").alias("share")).agg((F.min("_x") * (1 - share) + F.max("_x") * share).alias("value"))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "share", "value")


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str, prefix: str = "_w_") -> DataFrame:
    """Join in which null keys meet; columns of the second side get a prefix."""
    b = b.select(*[F.col(x).alias(f"{prefix}{x}") for x in b.columns])
    cond = F.lit(True)
    for x in on:
        cond = cond & F.col(x).eqNullSafe(F.col(f"{prefix}{x}"))
    return a.join(b, cond, how)


def wide_quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """One row per key with a column per quantile."""
    long = quantiles(df, keys, x, list(dict.fromkeys(shares.values())))
    cols = [F.max(F.when(F.col("share") == float(s), F.col("value"))).alias(n) for n, s in shares.items()]
    return long.groupBy(*keys).agg(*cols) if keys else long.agg(*cols)
