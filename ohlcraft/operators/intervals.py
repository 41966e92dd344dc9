"""Range joins between events or zones and bars as equi-joins on chunks of bar ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import KEY
from .ladder import first_crossing  # noqa: F401  (the search without a horizon is imported from here too)


def bars_between(events: DataFrame, bars: DataFrame, lo: Column, hi: Column, size: int, cols: list[str],
                 key: str = KEY, prefix: str = "b_") -> DataFrame:
    """Pair every event with the bars whose ``idx`` is in ``[lo, hi]``.

    The event is copied to each chunk of ``size`` ordinals its range touches, so the join
    key is ``(symbol, chunk)``: no task holds more than one chunk of bars of a symbol.
    """
    ev = events.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).filter("_hi >= _lo")
    ev = ev.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    right = bars.select(
        F.col(key).alias("_k"), F.floor(F.col("idx") / size).alias("_c"), F.col("idx").alias(f"{prefix}idx"),
        *[F.col(c).alias(f"{prefix}{c}") for c in cols],
    )
    joined = ev.join(right, (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_c")))
    return joined.filter(F.col(f"{prefix}idx").between(F.col("_lo"), F.col("_hi"))).drop("_k", "_c", "_lo", "_hi", "_chunk")
