"""As-of joins without a non-equi join: both sides in one stream, last value carried on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import KEY


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, cols: list[str], span: int, key: str | None = KEY,
         prefix: str = "", age: str | None = None, forward: bool = False) -> DataFrame:
    """Attach to each left row the last right row at or before it (``forward``: first at or after).

    Rows are grouped into slots of ``span`` time units. Inside a slot the nearest right row is
    found by a window; what a slot inherits from earlier slots is one row per slot. So a task
    holds one slot of one symbol, not its whole history.
    """
    keys = [key] if key else []
    taken = [F.col(c).alias(f"{prefix}{c}") for c in cols]
    names = [f"{prefix}{c}" for c in cols]
    packed = F.struct(F.col(right_on).alias("_rt"), *taken)
    r = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"))
    lcols = left.columns
    l = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).unionByName(
        l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
    ).withColumn("_slot", F.floor(F.col("_t") / span))
    part = [*keys, "_slot"]
    if forward:
        win = Window.partitionBy(*part).orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    else:
        win = Window.partitionBy(*part).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last("_r", ignorenulls=True).over(win)
    pick = F.min_by if forward else F.max_by
    ends = r.withColumn("_slot", F.floor(F.col("_t") / span)).groupBy(*part).agg(pick("_r", "_t").alias("_edge"))
    slots = left.select(*keys, F.floor(F.col(left_on) / span).alias("_slot")).distinct()
    steps = ends.unionByName(slots.withColumn("_edge", F.lit(None).cast(r.schema["_r"].dataType))).groupBy(*part).agg(
        F.first("_edge", ignorenulls=True).alias("_edge"))
    order = F.col("_slot").desc() if forward else F.col("_slot")
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    inherited = steps.select(*part, F.last("_edge", ignorenulls=True).over(over).alias("_old"))
    out = (
        both.withColumn("_near", near)
        .filter("_side = 1")
        .join(inherited, part, "left")
        .withColumn("_hit", F.coalesce("_near", "_old"))
    )
    final = [F.col(f"_l.{c}").alias(c) for c in lcols] + [F.col(f"_hit.{n}").alias(n) for n in names]
    if age:
        gap = F.col("_hit._rt") - F.col(f"_l.{left_on}") if forward else F.col(f"_l.{left_on}") - F.col("_hit._rt")
        final.append(gap.alias(age))
    return out.select(*final)


def keep_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in priority order, one row per key: the earlier frame wins."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in merged.columns if c not in (*keys, "_p")]
    best = merged.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
