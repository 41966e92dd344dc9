"""Correlations, leading factors, rolling factors and distributed quantiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.operators.selection import quantiles, wide_quantiles
from ohlcraft.plans import spectra as S


def panel_of(spark, m, names=None):
    names = names or [f"a{j:05d}" for j in range(m.shape[1])]
    rows = [(int(i), names[j], float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if not np.isnan(m[i, j])]
    return spark.createDataFrame(rows, "idx long, symbol string, r double"), names


def factor_matrix(n, p, k, seed):
    g = np.random.default_rng(seed)
    return g.normal(size=(n, k)) @ (g.normal(size=(k, p)) * np.linspace(2, 1, k)[:, None]) + g.normal(size=(n, p))


@pytest.mark.parametrize("fill", [None, 0.0])
def test_blocked_correlations(spark, monkeypatch, fill):
    monkeypatch.setattr(S, "BARS", 7)
    monkeypatch.setattr(S, "ASSETS", 4)
    monkeypatch.setattr(S, "FAN_IN", 2)
    m = factor_matrix(40, 11, 2, 1)
    m[:, 5] = 3.0  # does not vary
    m[3, 2] = m[30, 7] = np.nan
    df, names = panel_of(spark, m)
    df = df.unionByName(spark.createDataFrame([(3, "rare", 1.0)], df.schema))  # one value only: not an asset
    full = m[~np.isnan(m).any(axis=1)] if fill is None else np.nan_to_num(m)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(full.T)
    got = {(r.a, r.b): r.rho for r in S.correlations(df, fill=fill).collect()}
    assert len(got) == 11 * 12 // 2
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            if i == 5 or j == 5:
                assert got[(a, b)] is None or abs(full[:, 5].std()) > 0
            else:
                assert got[(a, b)] == pytest.approx(want[i, j], abs=1e-9)


@pytest.mark.parametrize("p", [9, 90])
def test_leading_factors_with_fewer_and_more_assets_than_vectors(spark, p):
    m = factor_matrix(150, p, 3, 2)
    df, names = panel_of(spark, m)
    lam, vec = np.linalg.eigh(np.corrcoef(m.T))
    edge = (1 + np.sqrt(p / 150)) ** 2
    r = S.spectrum(df, "idx", "symbol", "r").first()
    c = np.corrcoef(m.T)
    assert (r.p, r.n_obs, r.n_factors) == (p, 150, int((lam > edge).sum()))
    assert r.pc1_share == pytest.approx(lam[-1] / p, rel=1e-7) and r.mean_corr == pytest.approx((c.sum() - p) / (p * (p - 1)), abs=1e-9)
    w = {x.asset: x.w for x in S.first_weights(df, "idx", "symbol", "r").collect()}
    v = vec[:, -1] * np.sign(vec[:, -1].sum())
    assert [w[n] for n in names] == pytest.approx(v.tolist(), abs=1e-4)


def test_more_factors_than_vectors_double_the_block(spark):
    m = factor_matrix(400, 40, 12, 3)
    df, _ = panel_of(spark, m)
    cells, n, p = S.varying(df, "idx", "symbol", "r", None)
    lam = np.linalg.eigvalsh(np.corrcoef(m.T))[::-1]
    edge = lam[9] - 1e-6
    values, _ = S.leading_factors(S.standardised(cells, n), p, edge, width=4)
    assert values[:10].tolist() == pytest.approx(lam[:10].tolist(), rel=1e-5)


def test_twenty_thousand_assets(spark):
    n, p = 24, 20_000
    h = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1_000_003)) / 1_000_003.0 - 0.5
    df = spark.range(n * p).select((F.col("id") % n).alias("idx"), F.floor(F.col("id") / n).alias("symbol")).withColumn(
        "r", h(F.col("idx"), F.lit(1)) * (1 + h(F.col("symbol"), F.lit(2))) + h("idx", "symbol"))
    rows = df.toPandas()
    m = np.zeros((n, p))
    m[rows["idx"], rows["symbol"]] = rows["r"]
    z = m - m.mean(axis=0)
    z /= np.sqrt((z * z).sum(axis=0))
    lam = np.linalg.eigvalsh(z @ z.T)
    r = S.spectrum(df, "idx", "symbol", "r").first()
    assert (r.p, r.n_obs) == (p, n) and r.pc1_share == pytest.approx(lam[-1] / p, rel=1e-7)
    assert r.n_factors == int((lam > (1 + np.sqrt(p / n)) ** 2).sum())


@pytest.mark.parametrize("p", [5, 40])
def test_window_loadings(spark, monkeypatch, p):
    monkeypatch.setattr(S, "CHUNK", 16)
    n, m = 12, factor_matrix(60, p, 1, 4)
    m[20, 1] = np.nan
    m[:30, 2] = 1.0
    df, names = panel_of(spark, m)
    got = {}
    for r in S.window_loadings(df, n, 3, 1).collect():
        got.setdefault(r.t, {})[r.asset] = (r.beta, r.share, r.n_assets)
    assert sorted(got) == [t for t in range(n, 60) if t % 3 == 1]
    for t, row in got.items():
        w = m[t - n : t]
        use = [j for j in range(p) if not np.isnan(w[:, j]).any() and w[:, j].std() > 0]
        lam, vec = np.linalg.eigh(np.corrcoef(w[:, use].T))
        v = vec[:, -1] * np.sign(vec[:, -1][np.abs(vec[:, -1]).argmax()])
        assert sorted(row) == [names[j] for j in use]
        assert [row[names[j]][0] for j in use] == pytest.approx(v.tolist(), abs=1e-7)
        assert row[names[use[0]]][1] == pytest.approx(lam[-1] / len(use), rel=1e-9)


def test_residual_book(spark):
    m, (w, n, k, every) = factor_matrix(120, 8, 1, 5), (30, 12, 2, 6)
    df, _ = panel_of(spark, m)
    got = {r.t: (r.gross, r.net) for r in S.residual_book(df, w, n, k, every, 0.01).collect()}
    want = {}
    for t in range(w + n, len(m) - every, every):
        lam, vec = np.linalg.eigh(np.corrcoef(m[t - w : t].T))
        b = vec[:, -1] * np.sign(vec[:, -1][np.abs(vec[:, -1]).argmax()])
        look = m[t - n + 1 : t + 1]
        order = np.argsort((look - np.outer(look @ b, b)).sum(axis=0))
        ahead = m[t + 1 : t + 1 + every]
        g = float((ahead[:, order[:k]].mean(axis=1) - ahead[:, order[-k:]].mean(axis=1)).sum())
        want[t] = (g, g - 0.01)
    assert sorted(got) == sorted(want)
    for t, v in want.items():
        assert got[t] == pytest.approx(v, abs=1e-9)


def test_quantiles_of_hot_groups_ties_and_nulls(spark):
    g = np.random.default_rng(6)
    groups = {"hot": g.integers(0, 50, 3000).astype(float), "tied": np.full(500, 2.5), "one": np.array([7.0]), None: g.normal(size=40)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {(r.k, r.share): r.value for r in quantiles(df, ["k"], "x", shares).collect()}
    assert len(got) == len(groups) * len(shares)
    for k, vs in groups.items():
        for s in shares:
            assert got[(k, s)] == pytest.approx(np.quantile(vs, s), abs=1e-12)
    row = wide_quantiles(df, [], "x", {"p10": 0.1, "p90": 0.9}).first()
    every = np.concatenate(list(groups.values()))
    assert (row.p10, row.p90) == pytest.approx((np.quantile(every, 0.1), np.quantile(every, 0.9)))
    assert quantiles(df.filter("x is null"), ["k"], "x", [0.5]).collect() == []
