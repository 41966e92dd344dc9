"""Results must not depend on how a symbol is cut, nor on bars that come later."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import fold as fold_module
from ohlcraft.operators import frames
from ohlcraft.operators import kernels as K
from ohlcraft.operators.fold import fold
from ohlcraft.operators.frames import Frame, number_bars, ordinals
from ohlcraft.operators.recursion import ema_chain, recur, rma_chain
from ohlcraft.operators.running import running, two_state
from ohlcraft.queries import load
from ohlcraft.queries.base import INDICATORS

load()
CAUSAL = sorted(n for n, (_, ahead, _, _) in INDICATORS.items() if ahead == 0)


def walk(n, seed=7, start=100.0):
    rng, x, out = random.Random(seed), start, []
    for _ in range(n):
        o = x
        x *= math.exp(rng.gauss(0, 0.02))
        hi, lo = max(o, x) * (1 + abs(rng.gauss(0, 0.01))), min(o, x) * (1 - abs(rng.gauss(0, 0.01)))
        out.append((o, hi, lo, x, float(rng.randint(1, 50))))
    return out


@pytest.fixture(scope="module")
def walks(spark):
    rows = [(s, i, i * 3_600_000, *r) for s, n in (("A", 420), ("B", 230)) for i, r in enumerate(walk(n, seed=n))]
    df = spark.createDataFrame(rows, "symbol string, idx long, ts long, open double, high double, low double, close double, volume double")
    return df.cache()


def table(df, keys):
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[tuple(d[k] for k in keys)] = {k: v for k, v in d.items() if k not in keys}
    return out


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def assert_same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for col in a[k]:
            assert same(a[k][col], b[k][col]), (k, col, a[k][col], b[k][col])


# indicators of different kinds: rolling, recursive, chained, varying, running, two-state, patterns
SAMPLE = ["sma", "linreg", "ema", "tema", "t3", "kama", "vidya", "zlma", "rsi", "macd", "fisher", "streak", "crsi", "tsi", "adx", "hilo",
          "heikin_ashi", "ott_sma", "ott_wwma", "atr", "stoch", "cdl_engulfing", "cdl_shortline", "cumulative", "percent_rank_window"]


@pytest.mark.parametrize("name", SAMPLE)
def test_chunk_size_does_not_matter(walks, name):
    back, ahead, build, outs = INDICATORS[name]
    small = 160 if back <= 110 else 2 * back
    results = []
    for size in (small, 4096 if name not in ("kama", "vidya", "fisher", "heikin_ashi", "stc", "crsi", "ott_wwma") else 450):
        f = build(Frame.of_numbered(walks, back, ahead, size))
        results.append(table(f.core("symbol", "idx", *outs), ["symbol", "idx"]))
    assert_same(*results)


@pytest.mark.parametrize("name", ["sma", "ema", "rsi", "atr", "macd", "adx", "kama", "cdl_morningstar" if "cdl_morningstar" in CAUSAL else "roc", "zscore", "hilo"])
def test_later_bars_do_not_change_earlier_values(walks, name):
    back, ahead, build, outs = INDICATORS[name]
    full = table(build(Frame.of_numbered(walks, back, ahead, 512)).core("symbol", "idx", *outs).filter("idx < 150"), ["symbol", "idx"])
    prefix = table(build(Frame.of_numbered(walks.filter("idx < 150"), back, ahead, 512)).core("symbol", "idx", *outs), ["symbol", "idx"])
    assert_same(full, prefix)


def test_recursion_against_a_loop(walks):
    f = recur(Frame.of_numbered(walks, 20, size=64), [ema_chain(["e"], F.col("close"), 9), rma_chain(["r"], F.col("close"), 9)])
    got = table(f.core("symbol", "idx", "e", "r"), ["symbol", "idx"])
    for s, n in (("A", 420), ("B", 230)):
        x = [r[3] for r in walk(n, seed=n)]
        for col, a in (("e", 2 / 10), ("r", 1 / 9)):
            y = sum(x[:9]) / 9
            assert got[(s, 7)][col] is None and same(got[(s, 8)][col], y)
            for i in range(9, n):
                y += a * (x[i] - y)
                assert same(got[(s, i)][col], y)


def test_a_missing_input_stays_missing(walks):
    f = Frame.of_numbered(walks, 20, size=64).add(x=F.when(F.col("idx") != 100, F.col("close")))
    got = table(recur(f, [ema_chain(["e"], F.col("x"), 5)]).core("symbol", "idx", "e"), ["symbol", "idx"])
    assert got[("A", 99)]["e"] is not None
    assert all(got[("A", i)]["e"] is None for i in range(100, 420))


def test_running_and_two_state(walks):
    f = Frame.of_numbered(walks, 10, size=48)
    f = running(f, 2, hi=("max", F.col("close")), seen=("last", F.when(F.col("idx") % 50 == 3, F.col("idx"))), n=("sum", F.lit(1)))
    up, dn = F.col("idx") % 37 == 5, F.col("idx") % 11 == 4
    f = two_state(f, "way", up, dn, 1, 2)
    got = table(f.core("symbol", "idx", "hi", "seen", "n", "way"), ["symbol", "idx"])
    x, way = [r[3] for r in walk(420, seed=420)], 1
    for i in range(420):
        u, d = i % 37 == 5, i % 11 == 4
        way = -way if u and d else 1 if u else -1 if d else way
        last = (i - 3) // 50 * 50 + 3 if i >= 3 else None
        assert same(got[("A", i)]["hi"], max(x[: i + 1])) and got[("A", i)]["n"] == i + 1
        assert got[("A", i)]["seen"] == last and got[("A", i)]["way"] == way


@pytest.mark.parametrize("kernel,inputs,outs", [
    (K.mcginley(10), ["x"], {"y": "double"}), (K.kagi(4.0), ["x"], {"way": "long"}), (K.renko(3.0), ["x", "p0"], {"way": "long"}),
    (K.point_figure(2.0, 3), ["x"], {"way": "long"}), (K.super_smoother(12), ["x"], {"y": "double"}), (K.jurik(7), ["x"], {"y": "double"}),
    (K.adaptive_phase(), ["x"], {"mama": "double", "fama": "double"}), (K.zigzag(5.0), ["idx", "high", "low"], {"pivot_kind": "long"}),
])
def test_fold_in_pieces_equals_one_pass(walks, kernel, inputs, outs):
    first = walks.filter("idx = 0").select("symbol", F.col("close").alias("p0"))
    rows = walks.withColumn("x", F.col("close")).join(first, "symbol")
    one = table(fold(rows, kernel, inputs, outs, size=4096), ["symbol", "idx"])
    many = table(fold(rows, kernel, inputs, outs, warmup=20, size=90), ["symbol", "idx"])
    assert_same(one, many)


def test_numbering_and_ordinals(spark):
    rows = [("A", i * 7 % 1000, float(i % 3)) for i in range(1000)] + [("B", i, 1.0) for i in range(0, 500, 5)]
    df = spark.createDataFrame(rows, "symbol string, ts long, v double")
    got = number_bars(df, 1).collect()
    for s in "AB":
        mine = sorted((r for r in got if r.symbol == s), key=lambda r: r.ts)
        assert [r.idx for r in mine] == list(range(len(mine)))
    ranked = ordinals(df, ["symbol"], ["v", "ts"], "k").collect()
    for s in "AB":
        mine = sorted((r for r in ranked if r.symbol == s), key=lambda r: (r.v, r.ts))
        assert [r.k for r in mine] == list(range(len(mine)))


def test_small_default_chunks_for_whole_plans(spark, data, monkeypatch):
    from ohlcraft.functions import avs
    from ohlcraft.sources import tables as T

    b = T.bars(spark, data)
    want = table(avs.avsl(b).select("symbol", "idx", "avsl"), ["symbol", "idx"])
    monkeypatch.setattr(frames, "SIZE", 64)
    monkeypatch.setattr(fold_module, "SIZE", 64)
    assert_same(want, table(avs.avsl(b).select("symbol", "idx", "avsl"), ["symbol", "idx"]))


EVERY = {
    "zigzag": (K.zigzag(3.0), ["idx", "high", "low"], {"pivot_idx": "long", "pivot_price": "double", "pivot_kind": "long"}),
    "mcginley": (K.mcginley(5), ["x"], {"y": "double"}),
    "clusters": (K.chain_clusters(0.01, None), ["zlo", "zhi", "start"], {"opens": "long"}),
    "breaker": (K.breaker_bonus(3, 1.5, 4.0, 0.2), ["supply", "zlo", "zhi", "brk_close", "brk_atr", "base", "mult"], {"strength": "double"}),
}


@pytest.mark.parametrize("name", sorted(EVERY))
def test_fold_of_every_length(spark, name):
    """Histories of 1 to 3 chunks of bars each, one of which leaves a chunk with warm-up bars alone."""
    kernel, inputs, outputs = EVERY[name]
    rows = []
    for n in range(1, 25):
        for i, (o, h, low, x, v) in enumerate(walk(n, seed=n)):
            rows.append((f"n{n}", i, x, h, low, float(i % 2), min(o, x), max(o, x), float(i), x * 1.02 if i % 2 == 0 else x * 0.98, 1.0, v, 1.0))
    cols = "x, high, low, supply, zlo, zhi, start, brk_close, brk_atr, base, mult"
    df = spark.createDataFrame(rows, "symbol string, idx long, " + ", ".join(f"{c} double" for c in cols.split(", ")))
    got = table(fold(df, kernel, inputs, outputs, warmup=3, size=8), ["symbol", "idx"])
    local = df.toPandas()
    assert len(got) == len(local)
    for symbol, part in local.groupby("symbol"):
        part = part.sort_values("idx")
        made, _ = kernel({c: part[c].to_numpy() for c in inputs}, None)
        for k, i in enumerate(part["idx"]):
            for o in outputs:
                a, b = got[symbol, i][o], made[o][k]
                assert same(None if a is None else float(a), None if b != b else float(b)) or (a != a and b != b), (symbol, i, o, a, b)


def test_catalog_plans_over_its_whole_range(walks):
    from ohlcraft.functions.catalog import CATALOG, compute

    for name, spec in CATALOG.items():
        if spec.recursive:
            for pick in (1, 2):
                given = {k: v[pick] for k, v in spec.params.items()}
                assert compute(walks, name, given).columns[:2] == ["symbol", "idx"], (name, given)


@pytest.mark.parametrize("name, n", [("ema", 300), ("t3", 40), ("kama", 100), ("vidya", 2), ("vidya", 3)])
def test_catalog_sizes_do_not_change_values(walks, name, n):
    from dataclasses import replace

    from ohlcraft.functions.catalog import CATALOG, compute

    small = {**CATALOG, name: replace(CATALOG[name], size=lambda p: CATALOG[name].chunk(p) - 37)}
    assert_same(table(compute(walks, name, {"n": n}), ["symbol", "idx"]), table(compute(walks, name, {"n": n}, small), ["symbol", "idx"]))
