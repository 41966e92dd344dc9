"""Which zones are alive at a bar, answered without a row per zone and bar.

The lifetime of a zone is cut into aligned ranges of ``fan ** level`` bars, a few per level; a bar lies in one range per
level. Inside a range the bars and the edges and middles of its zones are sorted by price: the last middle below, the first
above and the balance of lower and upper edges so far tell the nearest zone and whether one holds the price. So rows grow
like ``(bars + zones) log n``. Ranges are cut into range partitions by :func:`ohlcraft.operators.scan.scan`, so that one
that holds all bars of a symbol has no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import KEY
from .scan import scan

FAN = 8
#: Copies of what is known of a range, dealt to the bars that lie in it.
COPIES = 4096


def aligned_ranges(start: Column, end: Column, top: int, fan: int = FAN) -> Column:
    """The aligned ranges (level, node) that make up the bars from ``start`` to ``end``, both included."""
    parts = []
    for k in range(top + 1):
        size = fan**k
        a, b = F.ceil(start / size).cast("long"), F.floor((end + 1) / size).cast("long")
        up_a, up_b = F.ceil(start / (size * fan)).cast("long") * fan, F.floor((end + 1) / (size * fan)).cast("long") * fan

        def run(x: Column, y: Column) -> Column:
            return F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))

        nodes = run(a, b) if k == top else F.when(up_a <= up_b, F.concat(run(a, up_a), run(up_b, b))).otherwise(run(a, b))
        level = F.lit(k).alias("level")
        parts.append(F.transform(nodes, lambda n: F.struct(level, n.alias("node"))))  # called at once: takes this level
    return F.flatten(F.array(*parts))


def live_zones(points: DataFrame, zones: DataFrame, fan: int = FAN, key: str = KEY) -> DataFrame:
    """Nearest and foremost zone of each kind alive at each point, and whether one holds its price.

    ``points``: key, ``idx``, ``price``, ``unit``. ``zones``: key, ``kind``, ``start`` and ``end`` (bars, both included),
    ``low``, ``high``, ``id``, ``rank``, ``carry`` (a struct). Result per point and kind with a live zone: ``near`` (distance
    of the middle in units, id, carry; the smaller id among equals), ``best`` (highest rank, then smallest id, as ``back`` =
    -id, and the distance of its middle), ``inside``.
    """
    last = points.agg(F.max("idx")).first()[0] or 0
    top = 0
    while fan ** (top + 1) <= last:
        top += 1
    middle = (F.col("low") + F.col("high")) / 2
    z = zones.filter("end >= start").withColumn("start", F.greatest("start", F.lit(0))).withColumn("mid", middle)
    z = z.select(key, "kind", "low", "high", "id", "mid", "rank", "carry", F.inline(aligned_ranges(F.col("start"), F.col("end"), top, fan)))
    group = [key, "level", "node", "kind"]
    size = F.pow(F.lit(float(fan)), F.col("level")).cast("long")
    copies = F.least(size, F.lit(COPIES).cast("long"))
    known = z.groupBy(*group).agg(F.max(F.struct("rank", (-F.col("id")).alias("back"), "mid")).alias("best")).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    bars = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns({"node": F.floor(F.col("idx") / size).cast("long"), "_copy": F.pmod(F.col("idx"), copies)})
    bars = bars.join(known, [key, "level", "node", "_copy"]).drop("_copy")
    mids = z.groupBy(*group, "mid").agg(F.min_by(F.struct("mid", "id", "carry"), "id").alias("zone"))
    rows = bars.select(*group, F.col("price").alias("px"), F.lit(2).alias("step"), F.col("idx").alias("tie"), F.struct("idx", "price", "unit", "best").alias("bar"))
    rows = rows.unionByName(mids.select(*group, F.col("mid").alias("px"), F.lit(1).alias("step"), F.col("zone.id").alias("tie"), "zone"), allowMissingColumns=True)
    for name, step, delta in (("low", 0, 1), ("high", 3, -1)):
        rows = rows.unionByName(z.select(*group, F.col(name).alias("px"), F.lit(step).alias("step"), F.col("id").alias("tie"), F.lit(delta).alias("delta")), allowMissingColumns=True)
    done = scan(rows, group, ["px", "step", "tie"], last={"below": F.col("zone")}, following={"above": F.col("zone")}, total={"open": F.col("delta")})

    def away(x: str) -> Column:
        gap = F.abs(F.col("bar.price") - F.col(f"{x}.mid")) / F.col("bar.unit")
        return F.when(F.col(x).isNotNull() & F.col("bar.price").isNotNull(), F.struct(gap.alias("distance"), F.col(f"{x}.id").alias("id"), F.col(f"{x}.carry").alias("carry")))

    best = F.struct(F.col("bar.best.rank").alias("rank"), F.col("bar.best.back").alias("back"), (F.abs(F.col("bar.price") - F.col("bar.best.mid")) / F.col("bar.unit")).alias("distance"))
    near = done.filter("step = 2").select(key, "bar.idx", "bar.unit", "kind", F.least(away("below"), away("above")).alias("near"), best.alias("best"), (F.coalesce("open", F.lit(0)) > 0).alias("inside"))
    return near.groupBy(key, "idx", "kind").agg(F.min("near").alias("near"), F.max("best").alias("best"), F.max("inside").alias("inside"), F.first("unit").alias("unit"))


def covering(points: DataFrame, intervals: DataFrame, keys: list[str], spans: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Number of intervals over each point (keys, ``idx``), for several (first bar, last bar) pairs of the same rows."""
    ends = F.array(*[F.struct(F.when(b >= a, at).cast("long").alias("idx"), *[F.lit(d if n == name else None).cast("int").alias(f"_{n}") for n in spans])
                     for name, (a, b) in spans.items() for at, d in ((a, 1), (b + 1, -1))])
    steps = intervals.select(*keys, F.inline(ends)).filter("idx is not null").groupBy(*keys, "idx").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in spans])
    rows = points.select(*keys, "idx", F.lit(1).alias("_side")).unionByName(steps.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    done = scan(rows, keys, ["idx", "_side"], total={n: F.col(f"_{n}") for n in spans})
    return done.filter("_side = 1").select(*keys, "idx", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in spans])
