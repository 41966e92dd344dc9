"""Standard errors, resampled intervals and nested folds against NumPy, on streams of several books."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.plans import inference as IN
from ohlcraft.plans import panel as PN


def mixed(*parts):
    x = 0
    for p in parts:
        x = ((x + p + 1) * 48271) % 2147483647
        x = (x * 69621 + 12345) % 2147483647
    return x


@pytest.fixture(scope="module")
def books():
    g = np.random.default_rng(3)
    noise = g.normal(0.1, 1, 900)
    slow = np.convolve(g.normal(size=930), np.ones(30) / 5, "valid")[:900] + 0.2
    return {"noise": noise, "slow": slow, "short": g.normal(size=20), "flat": np.full(60, 0.5)}


@pytest.fixture(scope="module")
def stream(spark, books):
    return spark.createDataFrame([(b, i, float(v)) for b, vs in books.items() for i, v in enumerate(vs)], "book string, idx long, r double").cache()


def test_nw_z(stream, books):
    got = {r.book: r.z for r in IN.nw_z(stream, 50).collect()}
    for b in ("noise", "slow"):
        v = books[b]
        rho = sum(np.corrcoef(v[:-k], v[k:])[0, 1] for k in range(1, 51))
        assert got[b] == pytest.approx(v.mean() / (v.std() / np.sqrt(len(v) / max(1.0, 1 + 2 * rho))), rel=1e-9)
    assert got["short"] is None and got["flat"] is None


@pytest.mark.parametrize("first", [2, 400])
def test_covariance_form_stops_early_whatever_the_bands(stream, books, first):
    got = {r.book: (r.n, r.used, r.sharpe_nw) for r in IN.nw_covariance_sharpe(stream, 200, 365, first=first).collect()}
    for b in ("noise", "slow", "short"):
        v = books[b]
        z, n, used = v - v.mean(), len(v), 0
        v0 = s = float(z @ z) / n
        for k in range(1, min(200, n - 1)):
            cov = float(z[k:] @ z[:-k]) / n
            if abs(cov) / v0 < 0.01:
                break
            s, used = s + 2 * cov, used + 1
        assert got[b][:2] == (n, used) and got[b][2] == pytest.approx(v.mean() * 365 / np.sqrt(max(s, 1e-18) * 365), rel=1e-8)


def test_annual_interval(stream, books):
    got = {r.book: (r.annual, r.lo, r.hi) for r in IN.annual_interval(stream, 30, 60).collect()}
    assert sorted(got) == ["flat", "noise", "slow"]
    for b, row in got.items():
        v, means = books[b], []
        n = len(v)
        for rep in range(60):
            starts = [mixed(7, rep, j) % (n - 30 + 1) for j in range(-(-n // 30))]
            means.append(np.concatenate([v[s : s + 30] for s in starts])[:n].mean())
        assert row == pytest.approx((v.mean() * 36500, *(np.percentile(means, [2.5, 97.5]) * 36500)), rel=1e-9)


def test_poisson_bootstrap(spark, books):
    rows = [(b, i, float(v), 0.1) for b, vs in books.items() for i, v in enumerate(vs)] + [("noise", 5000, None, 0.1)]
    df = spark.createDataFrame(rows, "book string, idx long, a double, b double")
    got = {r.book: (r.n, r.diff, r.lo, r.hi, r.p_le0) for r in IN.poisson_bootstrap(df, 40).collect()}
    counts = []
    for b, vs in books.items():
        d = vs - 0.1
        k = np.array([[sum(mixed(7, rep, i) >= t for t in IN.POISSON) for i in range(len(d))] for rep in range(40)])
        counts.append(k.ravel())
        m = (k * d).sum(axis=1) / k.sum(axis=1)
        assert got[b] == pytest.approx((len(d), d.mean(), *np.percentile(m, [2.5, 97.5]), (m <= 0).mean()), rel=1e-9, abs=1e-12)
    every = np.concatenate(counts)
    assert every.mean() == pytest.approx(1, abs=0.02) and every.var() == pytest.approx(1, abs=0.05)


def test_nested_folds(spark):
    day, g = PN.DAY_MS, np.random.default_rng(5)
    ts = np.sort(g.integers(0, 100 * day, 700))
    ts = np.r_[ts, ts[:60]]  # ties
    df = spark.createDataFrame([(int(t), i) for i, t in enumerate(ts)], "ts long, id long")
    folds = PN.nested_folds(df, 3, 20, 2, 0.25, 3)
    got = {}
    for r in PN.with_folds(df, folds).collect():
        for f in r.folds:
            got.setdefault((f.fold, f.part), set()).add(r.id)
    t0, t1 = int(ts.min()), int(ts.max())
    last = (t1 - t0) // (20 * day)
    want = {}
    for w in range(max(0, last - 2), last + 1):
        a, z = t0 + w * 20 * day, t0 + (w + 1) * 20 * day
        want[(w, "test")] = set(np.flatnonzero((ts >= a) & (ts < z)))
        train = np.flatnonzero(ts < a - 2 * day)
        cut = np.sort(ts[train])[int(len(train) * 0.75 + 1e-9)]
        want[(w, "train")], want[(w, "inner_train")] = set(train), set(train[ts[train] < cut])
        want[(w, "inner_val")] = set(train[ts[train] >= cut + 3 * day])
    assert got == {k: {int(i) for i in v} for k, v in want.items() if v}
    assert PN.with_folds(df, folds).count() == len(ts)


def test_feature_rows_carry_the_last_known_states(spark):
    base = spark.createDataFrame([("A", i, 100 * i) for i in range(6)] + [("B", 0, 50)], "symbol string, idx long, ts long")
    state = lambda rows: spark.createDataFrame(rows, "symbol string, known_ts long, v double").select("symbol", "known_ts", F.struct("v").alias("state"))
    out = PN.carried(base, {"h1": state([("A", 100, 1.0), ("A", 250, 2.0)]), "h2": state([("A", 500, 9.0), ("B", 51, 3.0)])})
    got = {(r.symbol, r.idx): (r.h1 and r.h1.v, r.h2 and r.h2.v) for r in out.collect()}
    assert got == {("A", 0): (None, None), ("A", 1): (1.0, None), ("A", 2): (1.0, None), ("A", 3): (2.0, None), ("A", 4): (2.0, None), ("A", 5): (2.0, 9.0), ("B", 0): (None, None)}
