"""Ordered scans without a task per key: running values over rows in any order, and as-of joins on top of them.

Rows are range-partitioned by keys and order together and written with their partition, so that a hot key, a hot span of
time and a heavy tie all spread out. A window runs inside each partition; what a partition hands to the next ones is one
row per key, and these rows (as many as there are keys and partitions) are combined in partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, keys: list[str], order: list[str], last: dict[str, Column] | None = None, following: dict[str, Column] | None = None,
         total: dict[str, Column] | None = None) -> DataFrame:
    """Add, per row in ``order`` inside ``keys`` (nulls are a key of their own):

    ``last``: the last non-null value up to and with this row; ``following``: the first non-null value behind this row;
    ``total``: the sum up to and with this row. ``order`` should tell rows apart, ties have no defined order.
    """
    from ..sources.store import settled

    last, following, total = last or {}, following or {}, total or {}
    parted = settled(df.withColumns({**{f"_x_{k}": v for k, v in (last | following | total).items()}}).repartitionByRange(*keys, *order)
                     .withColumn("_pid", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_pid").orderBy(*order)
    upto, behind = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*order)
    x = {k: F.col(f"_x_{k}") for k in (last | following | total)}
    at = {k: F.when(x[k].isNotNull(), place) for k in (last | following)}
    borders = parted.groupBy(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_bid")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max_by(x[k], at[k]).alias(f"_b_{k}") for k in last],
        *[F.min_by(x[k], at[k]).alias(f"_b_{k}") for k in following], *[F.sum(x[k]).alias(f"_b_{k}") for k in total])
    whole = Window.partitionBy(*([f"_k_{i}" for i in range(len(keys))] or [F.lit(0)])).orderBy("_bid")
    before, later = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    borders = borders.select(
        *[f"_k_{i}" for i in range(len(keys))], "_bid", *[F.last(f"_b_{k}", ignorenulls=True).over(before).alias(f"_b_{k}") for k in last],
        *[F.first(f"_b_{k}", ignorenulls=True).over(later).alias(f"_b_{k}") for k in following], *[F.sum(f"_b_{k}").over(before).alias(f"_b_{k}") for k in total])
    here = parted.withColumns({**{f"_w_{k}": F.last(x[k], ignorenulls=True).over(upto) for k in last},
                               **{f"_w_{k}": F.first(x[k], ignorenulls=True).over(behind) for k in following}, **{f"_w_{k}": F.sum(x[k]).over(upto) for k in total}})
    same = F.col("_pid") == F.col("_bid")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    out = here.join(borders, same)
    got = {k: F.coalesce(f"_w_{k}", f"_b_{k}") for k in last | following}
    got |= {k: F.coalesce(F.col(f"_w_{k}") + F.col(f"_b_{k}"), f"_w_{k}", f"_b_{k}") for k in total}
    return out.select(*df.columns, *[v.alias(k) for k, v in got.items()])


def asof_sorted(left: DataFrame, right: DataFrame, left_on: str, right_on: str, cols: list[str], keys: list[str] | None = None,
                prefix: str = "", forward: bool = False) -> DataFrame:
    """Attach to each left row the last right row at or before it (``forward``: first at or after), at any density of either side.

    Null keys match null keys. Left rows without a time find nothing. Of right rows at one time an arbitrary one is taken, as
    by any as-of join; make times unique for a defined result.
    """
    keys = keys or []
    names = [f"{prefix}{x}" for x in cols]
    packed = F.struct(F.lit(1).alias("_is"), *[F.col(x).alias(n) for x, n in zip(cols, names, strict=True)])
    r = right.filter(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_t"), F.lit(1 if forward else 0).alias("_side"), packed.alias("_r"))
    lcols = left.columns
    l = left.select(*keys, F.col(left_on).alias("_t"), F.lit(0 if forward else 1).alias("_side"), F.struct(*lcols).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).unionByName(l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    both = both.withColumn("_tie", F.xxhash64(F.col("_l"), F.col("_r")))
    spec = {"_near": F.col("_r")}
    done = scan(both, keys, ["_t", "_side", "_tie"], following=spec) if forward else scan(both, keys, ["_t", "_side", "_tie"], last=spec)
    near = F.when(F.col("_t").isNotNull(), F.col("_near"))
    return done.filter(F.col("_l").isNotNull()).select(*[F.col(f"_l.{x}").alias(x) for x in lcols], *[near[n].alias(n) for n in names])
