"""Hand-made cases with expected values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.functions import candles as C
from ohlcraft.operators.asof import asof, keep_first
from ohlcraft.operators.frames import Frame
from ohlcraft.operators.intervals import bars_between, first_crossing
from ohlcraft.operators.resample import duration_ms, resample
from ohlcraft.plans import outcomes as O
from ohlcraft.plans import portfolio as P
from ohlcraft.plans import signals as G

MIN = 60_000
BASE = 1_699_833_600_000  # a Monday, 00:00 UTC
NEUTRAL = (99.7, 100.4, 99.3, 100.0)


def minutes(spark, n):
    rows = [("A", BASE + i * MIN, 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 1.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")


def test_resample_drops_the_partial_bar(spark):
    got = resample(minutes(spark, 16), duration_ms("5m"), MIN).orderBy("ts").collect()
    assert [(r.ts - BASE) // MIN for r in got] == [0, 5, 10]
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume, got[0].n_bars) == (10.0, 16.0, 9.0, 15.0, 15.0, 5)
    assert got[0].known_ts == BASE + 5 * MIN
    with pytest.raises(ValueError):
        duration_ms("7m")


def test_weekly_bars_start_on_monday(spark):
    got = resample(minutes(spark, 5), duration_ms("1w"), MIN, drop_partial=False).collect()
    assert got[0].ts == BASE


def test_asof_is_inclusive_and_empty_before_the_first_row(spark):
    left = spark.createDataFrame([("A", t) for t in (5, 10, 11, 99)] + [("B", 50)], "symbol string, t long")
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 20, 2.0)], "symbol string, k long, v double")
    for span in (7, 1000):
        back = {(r.symbol, r.t): (r.v, r.age) for r in asof(left, right, "t", "k", ["v"], span, age="age").collect()}
        assert back == {("A", 5): (None, None), ("A", 10): (1.0, 0), ("A", 11): (1.0, 1), ("A", 99): (2.0, 79), ("B", 50): (None, None)}
        ahead = {(r.symbol, r.t): r.v for r in asof(left, right, "t", "k", ["v"], span, forward=True).collect()}
        assert ahead == {("A", 5): 1.0, ("A", 10): 1.0, ("A", 11): 2.0, ("A", 99): None, ("B", 50): None}


def test_upsert_keeps_the_first(spark):
    a = spark.createDataFrame([("A", 1, 1.0)], "symbol string, ts long, v double")
    b = spark.createDataFrame([("A", 1, 9.0), ("A", 2, 2.0)], "symbol string, ts long, v double")
    assert sorted((r.ts, r.v) for r in keep_first([a, b], ["symbol", "ts"]).collect()) == [(1, 1.0), (2, 2.0)]


@pytest.mark.parametrize("size", [2, 64])
def test_range_join_and_first_crossing(spark, bars, size):
    b = bars([(c, c + 1, c - 1, c) for c in (10, 11, 9, 12, 8, 15, 7)])
    ev = spark.createDataFrame([("A", 0, 1), ("A", 1, 4), ("A", 2, 6)], "symbol string, id long, at long")
    got = {}
    for r in bars_between(ev, b, F.col("at") + 1, F.col("at") + 2, size, ["close"]).collect():
        got.setdefault(r.id, []).append(r.b_idx)
    assert {k: sorted(v) for k, v in got.items()} == {0: [2, 3], 1: [5, 6]}
    x = first_crossing(ev, b, ["symbol", "id"], F.col("at"), "close", F.lit(8.5), F.col("id") % 2 == 0, "hit", size)
    assert {r.id: r.hit for r in x.collect()} == {0: 4, 1: 5, 2: None}


def _exit(spark, b, is_long=True, risk=1.0, target=2.0, horizon=3, idx=0):
    ev = spark.createDataFrame([("A", idx, is_long, 100.0, risk)], "symbol string, idx long, is_long boolean, close double, risk double")
    return O.r_exit(ev, b, ["symbol", "idx"], target, horizon, 0.0005).collect()[0]


def test_stop_wins_inside_a_bar(spark, bars):
    r = _exit(spark, bars([(100, 100, 100, 100), (100, 103, 98, 100)]))
    assert (r.gross, r.reason, r.exit_idx) == (-1.0, "sl", 1)
    assert math.isclose(r.net, -1 - 2 * 0.0005 * 100)


def test_target_time_and_end_of_data(spark, bars):
    assert _exit(spark, bars([(100, 100, 100, 100), (100, 101, 99.5, 100), (100, 102.5, 99.5, 102)])).reason == "tp"
    r = _exit(spark, bars([(100, 100, 100, 100)] + [(100, 100.5, 99.5, 100.5)] * 5))
    assert (r.reason, r.exit_idx, r.gross) == ("time", 3, 0.5)
    r = _exit(spark, bars([(100, 100, 100, 100), (100, 100.5, 99.5, 99.75)]))
    assert (r.reason, r.exit_idx, r.gross) == ("time", 1, -0.25)
    r = _exit(spark, bars([(100, 100, 100, 100)]))
    assert (r.reason, r.exit_idx, r.gross) == ("time", 0, 0.0)
    assert _exit(spark, bars([(100, 100, 100, 100), (100, 101.5, 97, 98)]), is_long=False).reason == "sl"


def test_open_trade_has_no_outcome(spark, bars):
    b = bars([(100, 100, 100, 100), (100, 100.5, 99.5, 100)])
    ev = spark.createDataFrame([("A", 0, True, 1, 100.0, 99.0, 102.0)], "symbol string, idx long, is_long boolean, fill_idx long, fill double, stop double, target double")
    r = O.barrier_outcome(ev, b, ["symbol", "idx"], 5, 0.001, 0.0005).collect()[0]
    assert r.r_net is None and r.exit_idx is None and r.exit_reason is None


CASES = {
    "engulfing": ([(101, 101.2, 99.4, 99.6), (99.5, 102, 99.3, 101.5)], 1.0),
    "hammer": ([(100, 100.3, 95, 100.2)], 1.0),
    "3whitesoldiers": ([(100, 102, 99.9, 101), (100.5, 103, 100.4, 102.5), (101.5, 105, 101.4, 104)], 1.0),
    "darkcloudcover": ([(100, 102, 99.9, 102), (103, 103.2, 100.4, 100.6)], -1.0),
    "morningstar": ([(105, 105.2, 99.8, 100), (99, 99.5, 98.5, 98.8), (99.5, 103.6, 99.4, 103.5)], 1.0),
    "inside": ([(100, 103, 97, 101), (100, 102, 98, 100)], 1.0),
    "marubozu": ([(100, 105, 100, 105)], 1.0),
    "2crows": ([(100, 105.5, 99.8, 105), (107, 107.2, 103.9, 104), (104.5, 104.6, 102.8, 103)], 1.0),
    "shootingstar": ([(100, 106, 99.9, 100.5)], 1.0),
    "gravestonedoji": ([(100, 103, 100, 100)], -1.0),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_candles(bars, name):
    tail, want = CASES[name]
    f = C.candle(Frame.of_numbered(bars([NEUTRAL] * 6 + tail), 6, 3), name, "y")
    got = {r.idx: r.y for r in f.core("idx", "y").collect()}
    assert got[5 + len(tail)] == want
    assert all(v == 0.0 for k, v in got.items() if k <= 5) or name == "inside"


def test_conditions_on_the_first_bars(bars):
    f = Frame.of_numbered(bars([(c, c, c, c) for c in (1, 2, 3, 3, 4, 5)]), 5)
    f, up = G.rising(f, "close", 3)
    f = f.add(up=G.true(up), back=G.history(f, "close", 2), ch=G.chain(F.lit(1), ("<", F.col("close")), ("<=", F.lit(3))))
    rows = f.core("idx", "up", "back", "ch").orderBy("idx").collect()
    assert [r.up for r in rows] == [False, False, True, False, False, True]
    assert [r.back for r in rows] == [None, None, 1, 2, 3, 3]
    assert [r.ch for r in rows] == [False, True, True, True, False, False]


def test_modulo_takes_the_sign_of_the_divisor(spark):
    got = spark.range(1).select(*[G.modulo(F.lit(a), F.lit(b)).alias(f"v{i}") for i, (a, b) in enumerate([(-7.0, 3.0), (7.0, -3.0), (7.0, 3.0)])]).head()
    assert list(got) == [-7.0 % 3.0, 7.0 % -3.0, 1.0]


def test_position_state_machine(spark):
    rows = [(0, 10, 20, 1.0), (1, 15, 18, 1.0), (2, 20, 30, 1.0), (3, 21, 25, -1.0), (4, 26, 40, 1.0), (5, 28, -1, 1.0), (6, 50, 60, 1.0)]
    df = spark.createDataFrame([("A", *r) for r in rows], "symbol string, idx long, decision long, exit long, side double")
    got = [r.status for r in P.state_machine(df, cooldown=3).orderBy("idx").collect()]
    assert got == ["taken", "in_position", "same_bar_after_exit", "cooldown", "taken", "in_position", "taken"]
    got = [r.status for r in P.state_machine(df, allow_reverse=True).orderBy("idx").collect()]
    assert got == ["taken", "in_position", "same_bar_after_exit", "taken", "taken", "in_position", "taken"]
    ended = spark.createDataFrame([("A", 0, 1, -1, 1.0), ("A", 1, 5, 6, 1.0)], "symbol string, idx long, decision long, exit long, side double")
    assert [r.status for r in P.state_machine(ended).orderBy("idx").collect()] == ["taken", "data_ended_open"]


def test_stream_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.05, 1, 300)
    df = spark.createDataFrame([("b", i, float(v)) for i, v in enumerate(r)], "book string, idx long, r double")
    rhos = [np.corrcoef(r[:-k], r[k:])[0, 1] for k in range(1, 21)]
    want = r.mean() / r.std() * np.sqrt(2190) / np.sqrt(max(1e-6, 1 + 2 * sum(rhos)))
    assert math.isclose(P.nw_sharpe(df, 20).head().sharpe_nw, want, rel_tol=1e-9)
    eq = np.cumprod(1 + 0.01 * r)
    assert math.isclose(P.drawdown(df).head().dd, np.max(1 - eq / np.maximum.accumulate(eq)), rel_tol=1e-9)
    cum = np.cumsum(r)
    assert math.isclose(P.drawdown_r(df).head().max_dd_r, np.max(np.maximum.accumulate(cum) - cum), rel_tol=1e-9)


def test_block_bootstrap_matches_a_loop(spark):
    r = [math.sin(i) + 0.1 for i in range(130)]
    df = spark.createDataFrame([("b", i, v) for i, v in enumerate(r)], "book string, idx long, r double")
    got = P.block_bootstrap(df, 40, 50, seed=11).head()

    def h(*parts):
        x = 0
        for p in parts:
            x = (x + p + 1) * 48271 % 2147483647
            x = (x * 69621 + 12345) % 2147483647
        return x

    means = []
    for rep in range(50):
        idx = [(h(11, rep, j) % 130 + k) % 130 for j in range(4) for k in range(40)][:130]
        means.append(np.mean([r[i] for i in idx]))
    assert math.isclose(got.ci_lo, np.percentile(means, 2.5), rel_tol=1e-9) and math.isclose(got.ci_hi, np.percentile(means, 97.5), rel_tol=1e-9)


def test_slot_admission(spark):
    rows = [(0, 0, 10, 1.0), (1, 1, 12, 2.0), (2, 2, 9, 3.0), (3, 10, 11, 0.5), (4, 11, 20, 5.0)]
    df = spark.createDataFrame([("x", *r) for r in rows], "book string, idx long, entry long, exit long, score double")
    assert [r.taken for r in P.admit_slots(df, 2).orderBy("idx").collect()] == [True, True, False, True, True]
    got = P.admit_slots(df, 2, replace_worst=True).orderBy("idx").collect()
    assert [r.taken for r in got] == [True, True, True, True, True] and got[2].replaces == 0.0


def test_jurik_and_adaptive_first_bars(bars):
    from ohlcraft.operators import kernels as K

    x = np.array([10.0, 11.0, 12.5, 11.5, 12.0, 13.0, 12.0, 12.5])
    y, _ = K.jurik(7)({"x": x}, None)
    assert y["y"][0] == 10.0 and np.all(np.isfinite(y["y"]))
    m, _ = K.adaptive_phase()({"x": x}, None)
    assert list(m["mama"][:6]) == list(x[:6])


def test_episodes_meet_within_their_book(spark):
    from ohlcraft.plans import portfolio as P

    cols = "book string, start_idx long, end_idx long"
    a = spark.createDataFrame([("x", 1, 5), ("x", 20, 30), ("y", 1, 5), (None, 2, 3)], cols)
    b = spark.createDataFrame([("x", 4, 9), ("y", 25, 26), (None, 3, 3)], cols)
    assert sorted(map(tuple, P.overlaps(a, b, "book").collect()), key=str) == sorted([("x", 1, 5), (None, 2, 3)], key=str)


def test_admission_does_not_depend_on_cuts(spark, monkeypatch):
    import random

    from ohlcraft.operators import fold
    from ohlcraft.plans import portfolio as P

    rng, t, rows = random.Random(3), 0, []
    for i in range(90):
        t += rng.randint(0, 3)
        rows.append(("b", i, t, t + rng.randint(1, 9), float(rng.randint(0, 20))))
    trades = spark.createDataFrame(rows, "book string, idx long, entry long, exit long, score double")
    for worst in (False, True):
        whole = sorted(map(tuple, P.admit_slots(trades, 2, worst, "book").select("idx", "taken").collect()))
        monkeypatch.setattr(fold, "SIZE", 16)
        assert sorted(map(tuple, P.admit_slots(trades, 2, worst, "book").select("idx", "taken").collect())) == whole
        monkeypatch.undo()
        held, expect = [], []
        for _, i, entry, leave, score in rows:  # the definition: at most two trades are open at once
            held = [h for h in held if h[0] > entry]
            if len(held) == 2 and worst and min(h[1] for h in held) < score:
                held.remove(min(held, key=lambda h: h[1]))
            took = len(held) < 2
            held += [(leave, score)] if took else []
            expect.append((i, took))
        assert whole == expect


def test_cosine_top_k_searches_all_vectors_in_blocks(spark, data, monkeypatch):
    from ohlcraft.plans import archive
    from ohlcraft.queries import load

    monkeypatch.setattr(archive, "MAX_QUERIES", 3)
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    best = {r.vec_id: np.sort(v @ x)[::-1][:5] for r, x in zip(rows, v, strict=True) if r.vec_id % 50 == 0}
    got = {}
    for r in load()[0]["cosine_top_k_all"](spark, data).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.score)
    assert len(best) > 3 and got.keys() == best.keys()
    for k, scores in got.items():
        assert np.allclose(scores, best[k], atol=2e-6)


def test_option_values_of_all_bars(spark, data):
    from ohlcraft.plans import factors
    from ohlcraft.queries import load
    from ohlcraft.sources import tables

    out = load()[0]["option_values"](spark, data)
    assert out.count() == tables.bars(spark, data).count() == out.filter("put >= 0").count()
    low = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (-1.0, 2.0), (3.0, 0.0)], "s double, k double")
    put = low.select(factors.put_value(F.col("s"), F.col("k"), F.lit(0.1), F.lit(0.6)).alias("p")).collect()
    assert [r.p for r in put] == [0.0, 2.0, 3.0, 0.0]
