"""Positions as scanned maps against the loops they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import states as SM
from ohlcraft.plans import factors as FA

c = F.col


def loops(z, prev, trend):
    """Reversion, momentum and hybrid positions, bar by bar."""
    rev, mom, hyb, p, q, h = [], [], [], 0, 0, 0
    for v, w, t in zip(z, prev, trend, strict=True):
        if v is not None:
            if (p == 1 and v >= 0.2) or (p == -1 and -v >= 0.2):
                p = 0
            p = 1 if v <= -1.5 else -1 if v >= 1.5 else p
            if w is not None:
                if q and q * v < 0.2:
                    q = 0
                if q == 0:
                    q = 1 if w <= 1 < v else -1 if w >= -1 > v else 0
            if t < 15:
                h = 0 if abs(v) <= 0.5 else h
                if abs(v) >= 1.5:
                    h = 1 if v < 0 else -1
            elif t > 20:
                if h == 0:
                    h = 1 if v > 1 else -1 if v < -1 else 0
                elif h * v < 0:
                    h = 0
        rev.append(p), mom.append(q), hyb.append(h)
    return rev, mom, hyb


@pytest.mark.parametrize("size", [4, 1024])
def test_positions_equal_the_loops_at_any_chunk_size(spark, size):
    draws, rows, want = random.Random(3), [], {}
    for s, n in (("A", 333), ("B", 1), ("C", 70)):
        z = [None if draws.random() < 0.1 else draws.gauss(0, 1.2) for _ in range(n)]
        prev, trend = [None, *z[:-1]], [draws.uniform(5, 30) for _ in range(n)]
        rows += [(s, i, *x) for i, x in enumerate(zip(z, prev, trend, strict=True))]
        want[s] = loops(z, prev, trend)
    df = spark.createDataFrame(rows, "symbol string, idx long, z double, pz double, t double")
    moves = (SM.reversion(c("z"), 1.5, 0.2), SM.momentum(c("z"), c("pz"), 1.0, 0.2), SM.hybrid(c("z"), c("t"), 15.0, 20.0, 1.5))
    for k, m in enumerate(moves):
        got = {(r.symbol, r.idx): (r.pos, r.was) for r in SM.states(df, m, "pos", "was", size=size).collect()}
        assert len(got) == len(rows)
        for s in want:
            for i, p in enumerate(want[s][k]):
                assert got[(s, i)] == (p, want[s][k][i - 1] if i else 0)


def carry(spark, rate, signal):
    df = spark.createDataFrame([("A", i, f, s) for i, (f, s) in enumerate(zip(rate, signal, strict=True))], "symbol string, idx long, rate double, signal double")
    return [r.r for r in FA.two_sided_carry(df).orderBy("idx").collect()]


def test_carry_signs_costs_and_missing_days(spark):
    up = carry(spark, [0.0003] * 30, [0.0003] * 30)
    assert up[0] == pytest.approx(0.0003 - 0.001) and up[1:] == pytest.approx([0.0003] * 29)
    down = carry(spark, [-0.0003] * 30, [-0.0003] * 30)
    assert down[0] == pytest.approx(0.0003 - 0.001) and down[1:] == pytest.approx([0.0003] * 29)
    turned = carry(spark, [0.0003] * 20, [0.0003] * 10 + [-0.0001] * 10)
    assert turned[10] == pytest.approx(-0.001) and turned[11:] == [0.0] * 9
    assert carry(spark, [0.0001] * 30, [0.0001] * 30) == [0.0] * 30
    gap = carry(spark, [0.0003, None, None, 0.0003], [0.0003, -1.0, -1.0, 0.0003])
    assert gap == pytest.approx([-0.0007, 0.0, 0.0, 0.0003])
