"""Chunked frames: row windows over one symbol without one task per symbol.

A plain ``partitionBy(symbol).orderBy(ts)`` window sends all bars of a symbol to a
single task. Here every bar first gets its ordinal ``idx`` inside the symbol, then
the symbol is cut into chunks of ``size`` consecutive bars, and each chunk also
receives the ``back`` bars before it and the ``ahead`` bars after it. A window that
reaches at most that far is then exact inside ``(symbol, chunk)``, and no task ever
holds more than ``back + size + ahead`` bars of one symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = "symbol"
SIZE = 1024
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS


def number_bars(bars: DataFrame, bar_ms: int, key: str = KEY, ts: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``idx``: the 0-based ordinal of each bar inside its symbol.

    Bars are unique per ``(symbol, ts)`` on a ``bar_ms`` grid, so a slot of ``1024``
    bar lengths holds at most 1024 rows. Slots are counted, the counts are summed up
    in slot order (one row per slot, not per bar) and the ordinal is the slot's
    offset plus the rank inside the slot. Rows that share a stamp (trades) need ``ties``
    for a total order and a ``bar_ms`` that keeps a slot small.
    """
    slot = F.floor(F.col(ts) / F.lit(bar_ms * SIZE)).cast("long")
    slotted = bars.withColumn("_slot", slot)
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(key, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    rank = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(ts, *ties))
    return (
        slotted.join(offsets, [key, "_slot"])
        .withColumn("idx", (F.col("_off") + rank - 1).cast("long"))
        .drop("_slot", "_off")
    )


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str = "idx") -> DataFrame:
    """0-based rank inside ``keys`` by any sortable columns, without sorting a key in one task.

    Rows are range-partitioned on keys and order together, so a large key or a heavy tie spreads
    over many partitions; ranks are the rank in the partition plus the rows of the key in the
    partitions before it. The partition number is written out first, so that both uses agree.
    """
    from ..sources.store import settled

    tagged = settled(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    counts = tagged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(*order))
    return tagged.join(offsets, [*keys, "_pid"]).withColumn(out, (F.col("_off") + rank - 1).cast("long")).drop("_pid", "_off")


@dataclass(frozen=True)
class Frame:
    """Bars laid out as overlapping chunks, plus the reach of the overlap."""

    df: DataFrame
    back: int
    ahead: int
    size: int
    key: str = KEY

    @staticmethod
    def of(
        bars: DataFrame,
        bar_ms: int,
        back: int,
        ahead: int = 0,
        size: int | None = None,
        key: str = KEY,
    ) -> "Frame":
        """Number the bars and copy each one into every chunk that can see it."""
        numbered = bars if "idx" in bars.columns else number_bars(bars, bar_ms, key)
        return Frame.of_numbered(numbered, back, ahead, size, key)

    @staticmethod
    def of_numbered(
        numbered: DataFrame, back: int, ahead: int = 0, size: int | None = None, key: str = KEY
    ) -> "Frame":
        size = size or SIZE
        first = F.greatest(F.floor((F.col("idx") - ahead) / size), F.lit(0))
        last = F.floor((F.col("idx") + back) / size)
        # the join of a recursion implies this filter on one of its sides: stating it on both lets them share a shuffle
        df = numbered.filter(F.col(key).isNotNull())
        df = df.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        return Frame(df, back, ahead, size, key)

    # -- window specs -----------------------------------------------------
    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(self.key, "chunk").orderBy("idx")

    def rows(self, n: int, lag: int = 0) -> WindowSpec:
        """The last ``n`` rows ending ``lag`` rows ago."""
        return self.w.rowsBetween(-(n - 1) - lag, -lag)

    def next_rows(self, n: int, start: int = 1) -> WindowSpec:
        """``n`` rows beginning ``start`` rows ahead."""
        return self.w.rowsBetween(start, start + n - 1)

    # -- columns ----------------------------------------------------------
    def add(self, **cols: Column) -> "Frame":
        return replace(self, df=self.df.withColumns(cols))

    def lag(self, x: Column, k: int = 1) -> Column:
        return x if k == 0 else F.lag(x, k).over(self.w)

    def lead(self, x: Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.w)

    def full(self, agg: Column, x: Column, n: int, lag: int = 0) -> Column:
        """``agg`` over the last n rows, NULL unless all n values are present."""
        win = self.rows(n, lag)
        return F.when(F.count(x).over(win) == n, agg.over(win))

    def settle(self) -> "Frame":
        """Cut the lineage here (see :func:`ohlcraft.sources.store.settled`)."""
        from ..sources.store import settled

        return replace(self, df=settled(self.df))

    # -- leaving the frame -------------------------------------------------
    @property
    def is_core(self) -> Column:
        return F.floor(F.col("idx") / self.size) == F.col("chunk")

    def core(self, *cols: str | Column) -> DataFrame:
        """Each bar once, from the chunk it belongs to."""
        out = self.df.filter(self.is_core)
        return out.select(*cols) if cols else out.drop("chunk")


def floor_mod(x: Column, m: int) -> Column:
    return x - F.floor(x / m) * m
