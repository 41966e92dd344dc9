"""Open-ended searches over bars: a ladder of extremes, climbed until a rung can hold a hit and descended to the bar.

Level 0 holds the bars in runs of ``fan``; each level above holds, per run of the level below, the minima and maxima of the
searched columns. A search reads the rest of its own run on every level at once, keeps the earliest nodes that may hold a hit, and
goes down one level per join. So an event meets two rows per level and descent, ``2 log n`` in all, instead of one summary
row per later chunk.

A condition is a function of the minima and the maxima of a node. It must be exact where both are the values of one bar,
and must hold for every node that contains such a bar. Conditions on a single threshold are exact on nodes as well and end
after one descent; for others a node may turn out to hold none, and the search goes on behind what it has followed.

A run is one row of ``fan`` entries. Runs of upper levels are read by more events than those of the lowest, so copies of
them are dealt out by the position that the search starts from, as many as the node has bars, up to ``COPIES``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import KEY

FAN = 16
COPIES = 4096
#: Nodes that a search follows at a time.
WIDEST = 256

#: ``condition(lo, hi)`` of structs with the searched columns.
Condition = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Ladder:
    """Runs of every level: key, level, run, items of (pos, lo, hi)."""

    runs: DataFrame
    top: int
    fan: int
    key: str

    @staticmethod
    def of(bars: DataFrame, cols: list[str], fan: int = FAN, key: str = KEY) -> "Ladder":
        from ..sources.store import settled

        values = F.struct(*[F.col(x) for x in cols])
        level = bars.select(key, F.col("idx").alias("pos"), values.alias("lo"), values.alias("hi"))
        last = bars.agg(F.max("idx")).first()[0] or 0
        top, out = 0, None
        while True:
            runs = level.groupBy(key, F.floor(F.col("pos") / fan).alias("run")).agg(
                F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("items"),
                F.struct(*[F.min(f"lo.{x}").alias(x) for x in cols]).alias("lo"), F.struct(*[F.max(f"hi.{x}").alias(x) for x in cols]).alias("hi"))
            runs = settled(runs.select(key, F.lit(top).alias("level"), "run", "items", "lo", "hi"))
            out = runs if out is None else out.unionByName(runs)
            if last < fan ** (top + 1):
                return Ladder(out.drop("lo", "hi"), top, fan, key)
            level = runs.select(key, F.col("run").alias("pos"), "lo", "hi")
            top += 1

    def _size(self, level: Column) -> Column:
        """Bars of a node."""
        return F.pow(F.lit(float(self.fan)), level).cast("long")

    def _holding(self, items: Column, level: Column, start: Column, condition: Condition) -> Column:
        """Nodes of a run from ``start`` on, and not behind ``_end``, that may hold a hit: (first bar, level, pos)."""
        size = self._size(level)
        held = F.filter(items, lambda x: (x["pos"] >= start) & F.coalesce(condition(x["lo"], x["hi"]), F.lit(False))
                        & (F.col("_end").isNull() | (x["pos"] * size <= F.col("_end"))))
        return F.transform(held, lambda x: F.struct((x["pos"] * size).alias("bar"), level.cast("int").alias("level"), x["pos"].alias("pos")))

    def _narrowed(self, nodes: DataFrame, events: list[str], width: int) -> DataFrame:
        """The first ``width`` nodes of each event, and where the first one left out begins, if that is before ``_next``."""
        every = F.sort_array(F.flatten(F.collect_list("_nodes")))
        out = nodes.groupBy(*events).agg(every.alias("_nodes"), F.min("_next").alias("_next"))
        return out.withColumns({"_next": F.least(F.col("_next"), F.get(F.col("_nodes"), width)["bar"]), "_nodes": F.slice("_nodes", 1, width)})

    def descents(self, pending: DataFrame, condition: Condition, width: int = 1) -> DataFrame:
        """One search of each event from its ``_p`` on that follows ``width`` nodes at a time.

        ``_nodes`` are the bars found, all those before ``_next``; ``_next`` is null if the search reached the last bar.
        """
        events = pending.columns
        size = self._size(F.col("level"))
        copies = F.least(size, F.lit(COPIES).cast("long"))
        climb = pending.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.top)))).withColumns({
            "run": F.floor(F.col("_p") / (size * self.fan)).cast("long"), "_copy": F.pmod(F.col("_p"), copies),
            "_from": F.floor(F.col("_p") / size).cast("long") + F.when(F.col("level") > 0, 1).otherwise(0)})
        dealt = self.runs.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
        seen = climb.join(dealt, [self.key, "level", "run", "_copy"])
        nodes = seen.select(*events, self._holding(F.col("items"), F.col("level"), F.col("_from"), condition).alias("_nodes"), F.lit(None).cast("long").alias("_next"))
        cur = self._narrowed(nodes.filter(F.size("_nodes") > 0), events, width)
        below = self.runs.select(F.col(self.key).alias("_k"), (F.col("level") + 1).alias("_l"), F.col("run").alias("_r"), "items")
        for _ in range(self.top):
            one = cur.select(*events, "_next", F.explode_outer("_nodes").alias("_n"))
            one = one.join(below, (F.col(self.key) == F.col("_k")) & (F.col("_n.level") == F.col("_l")) & (F.col("_n.pos") == F.col("_r")), "left")
            children = self._holding(F.col("items"), F.col("_n.level") - 1, F.lit(0), condition)
            kept = F.when(F.col("_n.level") > 0, children).when(F.col("_n.level") == 0, F.array("_n"))
            cur = self._narrowed(one.select(*events, "_next", kept.alias("_nodes")), events, width)
        return cur

    def hits(self, events: DataFrame, ids: list[str], after: Column, condition: Condition, reads: list[str], many: int = 1,
             until: Column | None = None, exact: bool = False) -> DataFrame:
        """The first ``many`` bars behind ``after`` (and not behind ``until``) that meet the condition: ids, ``nth`` (from 1), ``bar``.

        ``reads`` are the event columns that the condition reads; ``ids`` tell events apart and hold the key. ``exact`` says
        that a node that meets the condition always holds a bar that does: the search then ends with one descent of one node.
        Otherwise rounds follow more and more nodes at a time, up to ``WIDEST``.
        """
        from ..sources.store import settled

        cols = list(dict.fromkeys([*ids, *reads]))
        end = F.lit(None).cast("long") if until is None else until.cast("long")
        pending = events.select(*cols, F.greatest(after + 1, F.lit(0)).cast("long").alias("_p"), end.alias("_end"), F.lit(many).alias("_need")).filter(after.isNotNull())
        found, width = None, many if exact else max(many, 4)
        while True:
            now = settled(self.descents(pending, condition, width).withColumn("_nodes", F.slice("_nodes", F.lit(1), F.col("_need"))))
            part = now.select(*ids, (F.lit(many) - F.col("_need")).alias("_had"), F.posexplode("_nodes").alias("_i", "_n"))
            part = part.select(*ids, (F.col("_had") + F.col("_i") + 1).alias("nth"), F.col("_n.bar").alias("bar"))
            found = part if found is None else found.unionByName(part)
            rest = now.withColumn("_need", F.col("_need") - F.size("_nodes")).filter("_need > 0 and _next is not null")
            pending = rest.withColumn("_p", F.col("_next")).select(*cols, "_p", "_end", "_need")
            if exact or pending.isEmpty():
                return found
            width = min(4 * width, WIDEST)


def first_crossing(events: DataFrame, bars: DataFrame, ids: list[str], after: Column, x: str, level: Column, below: Column, out: str,
                   fan: int = FAN, key: str = KEY, inclusive: bool = False, ladder: Ladder | None = None) -> DataFrame:
    """First bar from ``after + 1`` on where ``x`` is beyond ``level``, with no horizon.

    ``below`` says per event whether beyond means under the level; ``inclusive`` lets equality count. A ladder over ``x`` can
    be handed in to be shared by several searches.
    """
    def beyond(lo: Column, hi: Column) -> Column:
        lower, upper = (lo[x] <= F.col("_lv"), hi[x] >= F.col("_lv")) if inclusive else (lo[x] < F.col("_lv"), hi[x] > F.col("_lv"))
        return F.when(F.col("_bl"), lower).otherwise(upper)

    ladder = ladder or Ladder.of(bars, [x], fan, key)
    ev = events.withColumns({"_at0": after.cast("long"), "_lv": level, "_bl": below})
    found = ladder.hits(ev, ids, F.col("_at0"), beyond, ["_lv", "_bl"], exact=True)
    return events.join(found.select(*ids, F.col("bar").alias(out)), ids, "left")
