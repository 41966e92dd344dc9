"""Cumulative values over the whole history of a symbol, chunk by chunk."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .frames import Frame

# kind -> (running aggregate, how the carried value and the local value combine)
_KINDS = {
    "sum": (F.sum, lambda old, new: F.coalesce(old + new, old, new)),
    "max": (F.max, lambda old, new: F.greatest(old, new)),
    "min": (F.min, lambda old, new: F.least(old, new)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda old, new: F.coalesce(new, old)),
    "first": (lambda x: F.first(x, ignorenulls=True), lambda old, new: F.coalesce(old, new)),
}


def running(frame: Frame, warm: int = 0, **specs: tuple[str, Column]) -> Frame:
    """Add ``out=(kind, x)`` columns: the aggregate of ``x`` from bar 0 to this bar.

    Every chunk is reduced to one row, these rows are combined in chunk order, and
    each chunk starts from the combined value of the chunks before it.
    """
    idx, chunk = F.col("idx"), F.col("chunk")
    origin = F.when(chunk > 0, chunk * frame.size - frame.back + warm).otherwise(F.lit(0))
    frame = frame.add(**{f"_r_{o}": F.when(idx >= origin, x) for o, (_, x) in specs.items()})
    own = frame.df.filter(idx < (chunk + 1) * frame.size - frame.back + warm)
    order = {"last": F.max_by, "first": F.min_by}
    partial = []
    for o, (kind, _) in specs.items():
        col = F.col(f"_r_{o}")
        if kind in order:
            partial.append(order[kind](col, F.when(col.isNotNull(), idx)).alias(f"_c_{o}"))
        else:
            partial.append(_KINDS[kind][0](col).alias(f"_c_{o}"))
    before = Window.partitionBy(frame.key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        own.groupBy(frame.key, "chunk")
        .agg(*partial)
        .select(
            frame.key,
            (chunk + 1).alias("chunk"),
            *[_KINDS[kind][0](F.col(f"_c_{o}")).over(before).alias(f"_c_{o}") for o, (kind, _) in specs.items()],
        )
    )
    here = frame.w.rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.add(**{f"_r_{o}": _KINDS[kind][0](F.col(f"_r_{o}")).over(here) for o, (kind, _) in specs.items()})
    df = frame.df.join(carried, [frame.key, "chunk"], "left")
    df = df.withColumns(
        {o: _KINDS[kind][1](F.col(f"_c_{o}"), F.col(f"_r_{o}")) for o, (kind, _) in specs.items()}
    ).drop(*[f"_{p}_{o}" for o in specs for p in "rc"])
    return replace(frame, df=df)


def two_state(frame: Frame, out: str, up: Column, down: Column, start: int = 1, warm: int = 0) -> Frame:
    """A state of +1 or -1: ``up`` alone sets +1, ``down`` alone sets -1, both flip it.

    Inside a chunk the state is the last one-sided signal flipped once per flip since;
    a chunk without one passes on the state it was given, flipped as often as it says.
    """
    idx, chunk = F.col("idx"), F.col("chunk")
    origin = F.when(chunk > 0, chunk * frame.size - frame.back + warm).otherwise(F.lit(0))
    live = idx >= origin
    yes = {k: live & F.coalesce(v, F.lit(False)) for k, v in (("_fu", up), ("_fd", down))}
    frame = frame.add(**yes)
    here = frame.w.rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.add(_fn=F.sum((F.col("_fu") & F.col("_fd")).cast("long")).over(here))
    side = F.when(F.col("_fu") != F.col("_fd"), F.struct(F.when(F.col("_fu"), 1).otherwise(-1).alias("d"), F.col("_fn").alias("n")))
    frame = frame.add(_fs=F.last(side, ignorenulls=True).over(here))

    def flipped(d: Column, n: Column) -> Column:
        return F.when(n % 2 == 1, -d).otherwise(d)

    frame = frame.add(_fc=flipped(F.col("_fs.d"), F.col("_fn") - F.col("_fs.n")))
    ends = frame.df.filter(idx == (chunk + 1) * frame.size - frame.back + warm - 1).select(
        frame.key, (chunk + 1).alias("chunk"), "_fc", "_fn"
    )
    before = Window.partitionBy(frame.key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    total = ends.withColumn("_ft", F.sum("_fn").over(before))
    const = F.when(F.col("_fc").isNotNull(), F.struct(F.col("_fc").alias("d"), F.col("_ft").alias("n")))
    entry = total.withColumn("_fe", F.last(const, ignorenulls=True).over(before)).select(
        frame.key,
        "chunk",
        flipped(F.coalesce(F.col("_fe.d"), F.lit(start)), F.col("_ft") - F.coalesce(F.col("_fe.n"), F.lit(0))).alias("_fe"),
    )
    df = frame.df.join(entry, [frame.key, "chunk"], "left")
    given = flipped(F.coalesce(F.col("_fe"), F.lit(start)), F.col("_fn"))
    df = df.withColumn(out, F.coalesce(F.col("_fc"), given)).drop("_fu", "_fd", "_fn", "_fs", "_fc", "_fe")
    return replace(frame, df=df)
