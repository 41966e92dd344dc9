"""Comparisons and divisions where rounding or a zero would decide."""

import math

from pyspark.sql import functions as F

from ohlcraft.functions import volatility as V
from ohlcraft.operators.frames import Frame
from ohlcraft.plans import signals as G


def test_equal_averages_do_not_cross(spark, bars):
    fast = [168.0, 168.96200000000002, 168.96, 168.97, 168.96199999999996, 167.0, 169.0]
    b = bars([(x, x, x, 168.962) for x in fast])
    got = {r.idx: (r.cross_up, r.cross_down) for r in G.crosses(Frame.of_numbered(b, 2), "open", "close").core().collect()}
    none = (False, False)
    assert [got[i] for i in range(7)] == [none, none, none, (True, False), none, none, (True, False)]
    loose = {r.idx: (r.cross_up, r.cross_down) for r in G.crosses(Frame.of_numbered(b, 2), "open", "close", False).core().collect()}
    assert [loose[i] for i in range(7)] == [none, none, (False, True), (True, False), none, (False, True), (True, False)]


def test_crosses_without_a_value_or_beyond_numbers(spark, bars):
    nan, inf = math.nan, math.inf
    b = bars([(x, x, x, 1.0) for x in (0.5, inf, 0.5, nan, -inf, 2.0)])
    b = b.withColumn("open", F.when(F.col("idx") != 2, F.col("open")))
    got = {r.idx: (r.cross_up, r.cross_down) for r in G.crosses(Frame.of_numbered(b, 2), "open", "close").core().collect()}
    none = (False, False)
    assert [got[i] for i in range(6)] == [none, (True, False), none, none, (False, True), (True, False)]


def test_percent_range_of_a_zero_close(spark, bars):
    f = Frame.of_numbered(bars([(10, 11, 9, 10)] * 15 + [(1, 1, 0, 0)]), 20)
    got = {r.idx: r.atr for r in V.atr(f, mode="sma", percent=True).core("idx", F.col("atr")).collect()}
    assert got[13] is None and math.isclose(got[14], 20.0) and got[15] == math.inf
