"""Positions of few states as an associative scan of maps, in window functions.

What a bar does to a position is a map from each state to the next one. Maps compose, so the map from the start of a chunk to
every bar of it comes from doubling: the map over ``2k`` bars is that over the last ``k`` after that over the ``k`` before.
The map of a whole chunk is one row; these rows are scanned the same way and hand each chunk the state it starts in. No bar
waits for another one, and nothing leaves the JVM.

A map is one number: the next states as digits, in the order of ``STATES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import KEY, SIZE

STATES = (-1, 0, 1)
_BASE = len(STATES)


def _digit(m: Column, place: Column | int) -> Column:
    """Index of the next state from the state of index ``place``."""
    power = F.lit(_BASE**place) if isinstance(place, int) else F.element_at(F.array(*[F.lit(_BASE**i) for i in range(_BASE)]), place + 1)
    return (F.floor(m / power) % _BASE).cast("int")


def _after(new: Column, old: Column) -> Column:
    """The map that does ``old`` first; a missing ``old`` does nothing."""
    both = sum((_digit(new, _digit(old, i)) * _BASE**i for i in range(_BASE)), F.lit(0))
    return F.when(old.isNull(), new).otherwise(both).cast("int")


def _scanned(df: DataFrame, m: str, part: list[str], order: str, length: int) -> DataFrame:
    """``m`` of each row after those of all rows before it in its part of at most ``length`` rows."""
    window, step = Window.partitionBy(*part).orderBy(order), 1
    while step < length:
        df = df.withColumn("_old", F.lag(m, step).over(window)).withColumn(m, _after(F.col(m), F.col("_old"))).drop("_old")
        step *= 2
    return df


def states(rows: DataFrame, moves: dict[int, Column], out: str, before: str | None = None, start: int = 0, size: int = SIZE, key: str = KEY) -> DataFrame:
    """Add ``out``, the state after each bar, and ``before``, the state it came with.

    ``rows``: key and ``idx``, numbered without gaps. ``moves`` gives, for each state, the next one; null keeps the state.
    """
    from ..sources.store import settled

    index = {s: i for i, s in enumerate(STATES)}
    numbered = [F.coalesce((moves[s] - STATES[0]).cast("int"), F.lit(index[s])) * _BASE ** index[s] for s in STATES]
    df = rows.withColumns({"_chunk": F.floor(F.col("idx") / size).cast("long"), "_m": sum(numbered, F.lit(0)).cast("int")})
    df = settled(_scanned(df, "_m", [key, "_chunk"], "idx", size))
    ends = df.groupBy(key, "_chunk").agg(F.max_by("_m", "idx").alias("_m"))
    chunks = (rows.agg(F.max("idx")).first()[0] or 0) // size + 1
    given = _scanned(ends, "_m", [key], "_chunk", chunks).select(key, (F.col("_chunk") + 1).alias("_chunk"), _digit(F.col("_m"), index[start]).alias("_given"))
    df = df.join(given, [key, "_chunk"], "left").withColumn("_given", F.coalesce("_given", F.lit(index[start])))
    df = df.withColumn(out, (_digit(F.col("_m"), F.col("_given")) + STATES[0]).cast("int"))
    if before:
        old = F.lag(out).over(Window.partitionBy(key, "_chunk").orderBy("idx"))
        df = df.withColumn(before, F.coalesce(old, F.col("_given") + STATES[0]).cast("int"))
    return df.drop("_chunk", "_m", "_given")


# -- positions on a z-score -----------------------------------------------------
def reversion(z: Column, enter: float, leave: float, short: bool = True) -> dict[int, Column]:
    """Long below ``-enter``, short above ``enter``; left when z comes back past ``leave``."""
    opened = F.when(z <= -enter, 1)
    if short:
        opened = opened.when(z >= enter, -1)
    return {0: opened, 1: F.coalesce(opened, F.when(z >= leave, 0)), -1: F.coalesce(opened, F.when(-z >= leave, 0))}


def momentum(z: Column, prev: Column, enter: float, leave: float) -> dict[int, Column]:
    """Opened by a fresh cross of ``±enter``, closed when z falls back inside ``leave``; a closing bar may open again."""
    seen = z.isNotNull() & prev.isNotNull()
    opened = F.when(seen & (prev <= enter) & (z > enter), 1).when(seen & (prev >= -enter) & (z < -enter), -1)
    closed = lambda v: F.when(seen & (v < leave), F.coalesce(opened, F.lit(0)))
    return {0: opened, 1: closed(z), -1: closed(-z)}


def hybrid(z: Column, trend: Column, quiet: float, trending: float, enter: float) -> dict[int, Column]:
    """Reversion while the trend index is low, momentum while it is high, otherwise hold."""
    calm = F.when(z <= -enter, 1).when(z >= enter, -1).when(F.abs(z) <= 0.5, 0)
    run = lambda in_trend: F.when(z.isNotNull() & (trend < quiet), calm).when(z.isNotNull() & (trend > trending), in_trend)
    return {0: run(F.when(z > 1, 1).when(z < -1, -1)), 1: run(F.when(z < 0, 0)), -1: run(F.when(z > 0, 0))}


def one_sided(signal: Column, enter: float, leave: float) -> dict[int, Column]:
    """On above ``enter``, off below ``leave``."""
    return {0: F.when(signal > enter, 1), 1: F.when(signal < leave, 0), -1: F.lit(None).cast("int")}


def dead_zone(rate: Column, signal: Column, zone: float) -> dict[int, Column]:
    """Against the sign of a signal outside the zone, flat once it changes sign; bars without a rate change nothing."""
    there = rate.isNotNull()
    return {0: F.when(there & (signal >= zone), -1).when(there & (signal <= -zone), 1), -1: F.when(there & (signal <= 0), 0), 1: F.when(there & (signal >= 0), 0)}
