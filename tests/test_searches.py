"""Searches over bars, ordered scans and live zones against brute force, and how many rows their joins make."""

import random

import pytest
from pyspark.sql import functions as F

from ohlcraft.operators.ladder import Ladder, first_crossing
from ohlcraft.operators.scan import asof_sorted, scan
from ohlcraft.operators.stabbing import aligned_ranges, covering, live_zones


def walk_of(n, seed, jump=1.0):
    draws, x, out = random.Random(seed), 50.0, []
    for _ in range(n):
        x += draws.choice([-jump, 0.0, jump])
        out.append(x)
    return out


@pytest.mark.parametrize("fan", [3])
def test_first_crossing_equals_the_loop(spark, fan):
    series = {"A": walk_of(700, 1), "B": walk_of(90, 2), "C": [None if i % 7 == 0 else v for i, v in enumerate(walk_of(300, 3))]}
    bars = spark.createDataFrame([(s, i, v) for s, xs in series.items() for i, v in enumerate(xs)], "symbol string, idx long, close double")
    draws = random.Random(4)
    events = [(s, e, draws.randrange(-1, len(xs) + 2), float(draws.randrange(25, 75)), draws.random() < 0.5) for s, xs in series.items() for e in range(120)]
    events += [("none", 0, 3, 50.0, True), ("A", 500, None, 50.0, True), ("A", 501, 0, None, True)]
    df = spark.createDataFrame(events, "symbol string, id long, at long, lv double, below boolean")
    for inclusive in (False, True):
        got = {(r.symbol, r.id): r.hit for r in first_crossing(df, bars, ["symbol", "id"], F.col("at"), "close", F.col("lv"), F.col("below"), "hit", fan=fan, inclusive=inclusive).collect()}
        for s, e, at, lv, below in events:
            xs = series.get(s, []) if at is not None and lv is not None else []
            test = (lambda v: v <= lv if below else v >= lv) if inclusive else (lambda v: v < lv if below else v > lv)
            want = next((i for i in range(max(0, (at or 0) + 1), len(xs)) if xs[i] is not None and test(xs[i])), None)
            assert got[(s, e)] == want, (s, e, at, lv, below, inclusive)


@pytest.mark.parametrize("many", [1, 3])
def test_searches_with_conditions_that_only_bars_decide(spark, many):
    n, draws = 900, random.Random(5)
    low = walk_of(n, 6, 2.0)
    high = [v + draws.choice([0.5, 1.0, 6.0]) for v in low]
    bars = spark.createDataFrame([("A", i, a, b) for i, (a, b) in enumerate(zip(low, high, strict=True))], "symbol string, idx long, low double, high double")
    events = [("A", e, draws.randrange(n), draws.uniform(20, 80), draws.choice([None, draws.randrange(n)])) for e in range(150)]
    df = spark.createDataFrame(events, "symbol string, id long, at long, z double, until long")
    # a bar whose low is under the price and whose high is 5 above it: no extremes of several bars decide that
    cond = lambda lo, hi: (lo["low"] < F.col("z")) & (hi["high"] > F.col("z") + 5)
    got = {}
    for r in Ladder.of(bars, ["low", "high"], fan=4).hits(df, ["symbol", "id"], F.col("at"), cond, ["z"], many, F.col("until")).collect():
        got.setdefault(r.id, []).append((r.nth, r.bar))
    for _, e, at, z, until in events:
        want = [i for i in range(at + 1, n) if low[i] < z and high[i] > z + 5 and (until is None or i <= until)][:many]
        assert sorted(got.get(e, [])) == [(k + 1, b) for k, b in enumerate(want)]


def joined_rows(spark, n, events):
    """Rows that the joins of one descent make: every event asks for a level that is met at the last bar only."""
    bars = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("idx"), F.col("id").cast("double").alias("close"))
    ladder = Ladder.of(bars, ["close"])
    pending = spark.range(events).select(F.lit("A").alias("symbol"), "id", (F.col("id") * (n // events)).alias("_p"), F.lit(float(n - 1)).alias("lv"), F.lit(None).cast("long").alias("_end"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = ladder.descents(pending, lambda lo, hi: hi["close"] >= F.col("lv"))
        assert {r._nodes[0].bar for r in df.collect()} == {n - 1}
        plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
        todo.append(plan)
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_joined_rows_grow_like_n_log_n(spark):
    few, many = joined_rows(spark, 1_000, 50), joined_rows(spark, 60_000, 3_000)
    # 60 times the events over 60 times the bars: two rows per event and level, of which 1,000 bars have 3 and 60,000 have 4
    assert few <= 50 * 2 * 3 and many <= 3_000 * 2 * 4


def test_scan_with_hot_keys_and_ties(spark):
    draws = random.Random(7)
    rows = [(k, draws.randrange(20), i, draws.choice([None, i])) for k, n in (("hot", 900), ("b", 40), (None, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    out = scan(df, ["k"], ["t", "i"], last={"l": F.col("v")}, following={"f": F.col("v")}, total={"s": F.col("v")})
    got = {(r.k, r.i): (r.l, r.f, r.s) for r in out.collect()}
    for k in ("hot", "b", None):
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k)
        for j, (_, i, _) in enumerate(mine):
            upto, behind = [x[2] for x in mine[: j + 1] if x[2] is not None], [x[2] for x in mine[j + 1 :] if x[2] is not None]
            assert got[(k, i)] == (upto[-1] if upto else None, behind[0] if behind else None, sum(upto) if upto else None)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_with_one_hot_span(spark, forward):
    draws = random.Random(8)
    right = sorted({draws.randrange(1000, 1400) for _ in range(200)} | {5, 90_000})
    left = [(i, draws.choice([draws.randrange(1000, 1400), 0, 50_000, 95_000, None])) for i in range(800)]
    l = spark.createDataFrame(left, "id long, at long")
    r = spark.createDataFrame([(t, t * 2) for t in right], "rt long, v long")
    got = {x.id: x.v for x in asof_sorted(l, r, "at", "rt", ["v"], forward=forward).collect()}
    assert len(got) == len(left)
    for i, at in left:
        near = [] if at is None else [t for t in right if (t >= at if forward else t <= at)]
        assert got[i] == (2 * (min(near) if forward else max(near)) if near else None)


def test_aligned_ranges_cover_exactly(spark):
    df = spark.createDataFrame([(a, b) for a in range(40) for b in range(a, 40)], "a long, b long")
    for r in df.select("a", "b", aligned_ranges(F.col("a"), F.col("b"), 2, 4).alias("n")).collect():
        assert sorted(i for x in r.n for i in range(x.node * 4**x.level, (x.node + 1) * 4**x.level)) == list(range(r.a, r.b + 1))
        assert len(r.n) <= 2 * 3 * 3


def test_live_zones_and_coverage_equal_the_loop(spark):
    draws, n = random.Random(11), 260
    price = walk_of(n, 12)
    zones = []
    for i in range(90):
        a, lo = draws.randrange(n), draws.uniform(35, 65)
        zones.append(("A", draws.choice(["s", "d"]), a, min(n - 1, a + draws.choice([0, 3, 40, 400])), lo, lo + draws.choice([0.5, 2.0, 8.0]), i, float(draws.randrange(5))))
    zones.append(("A", "s", 50, 40, 1.0, 2.0, 999, 9.0))  # never alive
    points = spark.createDataFrame([("A", i, p, 2.0) for i, p in enumerate(price)], "symbol string, idx long, price double, unit double")
    z = spark.createDataFrame(zones, "symbol string, kind string, start long, end long, low double, high double, id long, rank double")
    got = {(r.idx, r.kind): r for r in live_zones(points, z.withColumn("carry", F.struct(F.col("low").alias("at"))), fan=4).collect()}
    over = {(r.idx, r.kind): (r.one, r.two) for r in covering(points.select("symbol", "idx").withColumn("kind", F.explode(F.array(F.lit("s"), F.lit("d")))), z, ["symbol", "kind"],
            {"one": (F.col("start"), F.col("end")), "two": (F.when(F.col("id") % 2 == 0, F.col("start")), F.col("end"))}).collect()}
    for i, p in enumerate(price):
        for kind in "sd":
            live = [x for x in zones if x[1] == kind and x[2] <= i <= x[3]]
            assert over[(i, kind)] == (len(live), sum(x[6] % 2 == 0 for x in live))
            if not live:
                assert (i, kind) not in got
                continue
            r = got[(i, kind)]
            dist, which = min((abs(p - (x[4] + x[5]) / 2) / 2.0, x[6]) for x in live)
            best = max(live, key=lambda x: (x[7], -x[6]))
            assert (r.near.distance, r.near.id, r.inside) == (dist, which, any(x[4] <= p <= x[5] for x in live))
            assert (r.best.rank, -r.best.back, r.best.distance) == (best[7], best[6], abs(p - (best[4] + best[5]) / 2) / 2.0)
