"""Correlations and their leading factors without a matrix of all assets in one place.

Pairs come from blocked outer products: the panel is cut into tiles of bars by assets, two tiles of one stretch of bars are
multiplied in a task, and the products of a pair of asset blocks are added up over time. The leading eigenpairs need no
pairs at all: rounds of ``C v = Z'(Z v)`` are two joins and two sums over the cells of the standardised panel, for a block
of vectors at once. Only numbers of vectors by vectors (``WIDTH`` squared at most) come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import ordinals
from ..sources.store import settled

#: Bars and assets of a tile.
BARS, ASSETS = 1024, 512
#: Products of tiles that one task adds up.
FAN_IN = 32
#: Vectors carried at once, rounds at most, and the change of an eigenvalue that counts as none.
WIDTH, ROUNDS, TOLERANCE = 32, 60, 1e-9


def varying(panel: DataFrame, by: str, asset: str, x: str, fill: float | None) -> tuple[DataFrame, int, int]:
    """Cells (t, a, asset, x) of the assets with two values or more, and how many bars and assets there are.

    Without ``fill`` only bars on which all of them have a value count; else missing cells hold it.
    """
    cells = panel.filter(F.col(x).isNotNull()).select(F.col(by).alias("t"), F.col(asset).alias("asset"), F.col(x).cast("double").alias("x"))
    names = cells.groupBy("asset").agg(F.count("x").alias("_n")).filter("_n > 1").select("asset")
    named = settled(ordinals(names, [], ["asset"], "a"))
    n_assets = named.count()
    cells = cells.join(named, "asset").groupBy("t", "a", "asset").agg(F.sum("x").alias("x"))
    if fill is None:
        full = cells.groupBy("t").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_assets)
        cells = cells.join(full.select("t"), "t", "left_semi")
    elif fill != 0:
        raise ValueError("missing cells are left out or hold 0")
    times = panel.select(F.col(by).alias("t")).distinct() if fill is not None else cells.select("t").distinct()
    return settled(cells), times.count(), n_assets


def standardised(cells: DataFrame, n_bars: int) -> DataFrame:
    """``z``: a cell less its asset's mean, over the root of the asset's sum of squares; assets that don't vary are left out."""
    stats = cells.groupBy("a").agg((F.sum("x") / n_bars).alias("_m"))
    centred = cells.join(stats, "a").withColumn("x", F.col("x") - F.col("_m")).drop("_m")
    norm = centred.groupBy("a").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_s")).filter("_s > 0")
    return centred.join(norm, "a").withColumn("z", F.col("x") / F.col("_s")).drop("_s", "x")


def _products(tiles: DataFrame, stretches: int) -> DataFrame:
    """Sums of products over all bars, for each pair of asset blocks ``i <= j``: i, j and the matrix as bytes."""
    left = tiles.select("stretch", F.col("block").alias("i"), F.col("m").alias("left"))
    right = tiles.select("stretch", F.col("block").alias("j"), F.col("m").alias("right"))

    def multiply(batches):
        for pdf in batches:
            out = [(np.frombuffer(a, "<f8").reshape(-1, ASSETS).T @ np.frombuffer(b, "<f8").reshape(-1, ASSETS)).tobytes() for a, b in zip(pdf["left"], pdf["right"], strict=True)]
            yield pd.DataFrame({"stretch": pdf["stretch"], "i": pdf["i"], "j": pdf["j"], "m": out})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(ASSETS * ASSETS)
        for m in pdf["m"]:
            total += np.frombuffer(m, "<f8")
        return pd.DataFrame({"stretch": pdf["stretch"][:1], "i": pdf["i"][:1], "j": pdf["j"][:1], "m": [total.tobytes()]})

    schema = "stretch long, i long, j long, m binary"
    out = left.join(right, "stretch").filter("i <= j").select("stretch", "i", "j", "left", "right").mapInPandas(multiply, schema)
    while stretches > 1:
        stretches = -(-stretches // FAN_IN)
        out = out.withColumn("stretch", F.floor(F.col("stretch") / FAN_IN)).groupBy("i", "j", "stretch").applyInPandas(add, schema)
    return out.drop("stretch")


def correlations(panel: DataFrame, by: str = "idx", asset: str = "symbol", x: str = "r", fill: float | None = 0.0) -> DataFrame:
    """Correlation of every pair of assets ``(a, b, rho)``, ``a <= b`` in order of the assets; null where one doesn't vary."""
    cells, n_bars, _ = varying(panel, by, asset, x, fill)
    # centred on the mean of the cells that are there; missing cells are put right below
    means = cells.groupBy("a", "asset").agg((F.sum("x") / n_bars).alias("mean"))
    base = cells.join(means.select("a", "mean"), "a")
    if fill is None:
        base = base.withColumn("x", F.col("x") - F.col("mean"))
    placed = ordinals(base.select("t").distinct(), [], ["t"], "row")
    tiled = base.join(placed, "t").select(F.floor(F.col("row") / BARS).alias("stretch"), F.floor(F.col("a") / ASSETS).alias("block"),
                                          (F.col("row") % BARS).cast("int").alias("r"), (F.col("a") % ASSETS).cast("int").alias("k"), "x")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf["rows"].iloc[0]), ASSETS))
        m[pdf["r"], pdf["k"]] = pdf["x"]
        return pd.DataFrame({"stretch": pdf["stretch"][:1], "block": pdf["block"][:1], "m": [m.tobytes()]})

    # tiles of one stretch have the same number of rows, so that any two can be multiplied
    tall = tiled.groupBy("stretch").agg((F.max("r") + 1).alias("rows"))
    tiles = settled(tiled.join(tall, "stretch").groupBy("stretch", "block").applyInPandas(pack, "stretch long, block long, m binary"))
    products = _products(tiles, -(-n_bars // BARS))

    def spread(batches):
        for pdf in batches:
            for i, j, m in zip(pdf["i"], pdf["j"], pdf["m"], strict=True):
                s = np.frombuffer(m, "<f8").reshape(ASSETS, ASSETS)
                p, q = np.triu_indices(ASSETS) if i == j else [v.ravel() for v in np.indices(s.shape)]
                yield pd.DataFrame({"p": i * ASSETS + p, "q": j * ASSETS + q, "s": s[p, q]})

    sums = settled(products.mapInPandas(spread, "p long, q long, s double"))
    own = means.join(sums.filter("p = q").select(F.col("p").alias("a"), F.col("s").alias("ss")), "a")
    shift = F.lit(0.0) if fill is None else F.col("ma") * F.col("mb") * n_bars
    one = lambda s: own.select(F.col("a").alias("p" if s == "a" else "q"), F.col("asset").cast("string").alias(s), F.col("mean").alias(f"m{s}"), F.col("ss").alias(f"s{s}"))
    both = sums.join(one("a"), "p").join(one("b"), "q")
    square = (lambda s: F.col(f"s{s}")) if fill is None else (lambda s: F.col(f"s{s}") - n_bars * F.col(f"m{s}") * F.col(f"m{s}"))
    scale = F.sqrt(square("a")) * F.sqrt(square("b"))
    rho = F.when(F.col("p") == F.col("q"), F.when(square("a") > 0, 1.0)).otherwise((F.col("s") - shift) / F.nullif(scale, F.lit(0.0)))
    return both.select("a", "b", F.when(~F.isnan(rho), rho).alias("rho"))


# -- leading factors ----------------------------------------------------------
def _start(assets: DataFrame, width: int, exact: bool) -> DataFrame:
    """First vectors: unit vectors if there is one for each asset, else hashed numbers in [-1, 1]."""
    if exact:
        return assets.select("a", *[(F.col("place") == j).cast("double").alias(f"v{j}") for j in range(width)])
    return assets.select("a", *[(F.pmod(F.xxhash64("a", F.lit(j)), F.lit(2_000_003)) / 1_000_001.0 - 1.0).alias(f"v{j}") for j in range(width)])


def _times(cells: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``C v`` of each vector: the panel times the vectors, summed by bar, then by asset."""
    by_bar = cells.join(vectors, "a").groupBy("t").agg(*[F.sum(F.col("z") * F.col(f"v{j}")).alias(f"y{j}") for j in range(width)])
    return cells.join(by_bar, "t").groupBy("a").agg(*[F.sum(F.col("z") * F.col(f"y{j}")).alias(f"v{j}") for j in range(width)])


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Products of the vectors with each other; one matrix of ``width`` squared per batch of assets is added up by Spark."""
    names = [f"v{j}" for j in range(width)]

    def part(batches):
        for pdf in batches:
            m = pdf[names].to_numpy()
            g = m.T @ m
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": g.ravel()})

    out = np.zeros((width, width))
    for r in vectors.mapInPandas(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r.i, r.j] = r.g
    return out


def _turned(vectors: DataFrame, m: np.ndarray, width: int) -> DataFrame:
    names = [f"v{j}" for j in range(width)]

    def turn(batches):
        for pdf in batches:
            out = pd.DataFrame(pdf[names].to_numpy() @ m, columns=names)
            out.insert(0, "a", pdf["a"].to_numpy())
            yield out

    return vectors.mapInPandas(turn, "a long, " + ", ".join(f"{n} double" for n in names))


def leading_factors(cells: DataFrame, n_assets: int, above: float | None = None, width: int = WIDTH) -> tuple[np.ndarray, DataFrame]:
    """Leading eigenvalues of the correlation matrix, falling, and their vectors (a, v0, v1, ...).

    ``cells`` are standardised. Orthogonal iteration: multiply, orthonormalise by the Gram matrix, until the eigenvalues above
    ``above`` (the first alone by default) stand still. If all vectors are above it, twice as many are taken. With no more
    assets than vectors the start spans everything and one round is exact.
    """
    cells = settled(cells.select("t", "a", "z"))
    names = settled(ordinals(cells.select("a").distinct(), [], ["a"], "place"))
    exact = n_assets <= width
    width = min(width, n_assets)
    vectors, before = _start(names, width, exact), None
    for _ in range(ROUNDS):
        product = settled(_times(cells, vectors, width))
        s, u = np.linalg.eigh(_gram(product, width))
        s, u = np.maximum(s[::-1], 0.0), u[:, ::-1]
        values = np.sqrt(s)
        keep = values > 1e-8 * max(values[0], 1e-300)
        vectors = _turned(product, u * np.where(keep, 1 / np.where(keep, values, 1.0), 0.0), width)
        if before is not None or exact:
            wanted = max(1, int((values > above).sum())) if above is not None else 1
            if wanted == width and width < n_assets:
                return leading_factors(cells, n_assets, above, 2 * width)
            still = exact or (np.abs(values[:wanted] - before[:wanted]) <= TOLERANCE * values[0]).all() and (
                above is None or int((before > above).sum()) == int((values > above).sum()))
            if still:
                break
        before = values
    return values, settled(vectors)


def spectrum(panel: DataFrame, by: str, asset: str, x: str) -> DataFrame:
    """Share of the first factor, number of factors above the edge of a random matrix, mean correlation."""
    cells, n_obs, _ = varying(panel, by, asset, x, None)
    z = settled(standardised(cells, n_obs))
    p = z.select("a").distinct().count()
    edge = float((1 + np.sqrt(p / max(n_obs, 1))) ** 2)
    values, _ = leading_factors(z, p, edge) if p else (np.array([np.nan]), None)
    # the sum of all correlations is the squared length of the sum of the standardised columns
    whole = z.groupBy("t").agg(F.sum("z").alias("_s")).agg(F.sum(F.col("_s") * F.col("_s"))).first()[0] if p else None
    mean = (whole - p) / (p * (p - 1)) if p > 1 else None
    row = (p, n_obs, float(values[0] / p) if p else None, int((values > edge).sum()) if p else 0, mean)
    return panel.sparkSession.createDataFrame([row], "p int, n_obs int, pc1_share double, n_factors int, mean_corr double")


def first_weights(panel: DataFrame, by: str, asset: str, x: str) -> DataFrame:
    """First eigenvector per asset, signed so that its sum is positive."""
    cells, n_obs, _ = varying(panel, by, asset, x, None)
    z = settled(standardised(cells, n_obs))
    _, vectors = leading_factors(z, z.select("a").distinct().count())
    total = vectors.agg(F.sum("v0")).first()[0] or 0.0
    out = vectors.join(cells.select("a", "asset").distinct(), "a")
    return out.select(F.col("asset").cast("string").alias("asset"), (F.col("v0") * (-1.0 if total < 0 else 1.0)).alias("w"))


def factor_closeness(panel: DataFrame, by: str, asset: str, x: str) -> DataFrame:
    """Absolute correlation of each asset with the first factor's return, the weighted sum of all assets: 1 is pure factor."""
    cells, _, _ = varying(panel, by, asset, x, None)
    weights = first_weights(panel, by, asset, x).withColumnRenamed("asset", "_name")
    weighed = cells.join(weights, F.col("asset").cast("string") == F.col("_name"))
    score = weighed.groupBy("t").agg(F.sum(F.col("w") * F.col("x")).alias("score"))
    return cells.join(score, "t").groupBy(F.col("asset").cast("string").alias("asset")).agg(F.abs(F.corr("x", "score")).alias("closeness"))


# -- factors of trailing windows ----------------------------------------------
CHUNK = 1024


def window_loadings(panel: DataFrame, n: int, every: int = 1, phase: int = 0, by: str = "idx", asset: str = "symbol", x: str = "r") -> DataFrame:
    """First factor of the ``n`` bars before each bar ``t`` with ``t % every == phase``: (t, asset, beta, share, n_assets).

    Assets without a value on every bar of the window, and those that don't vary, are left out of it. The largest loading is
    positive. A task holds one chunk of bars and the ``n`` before it; with more assets than bars the eigenvector comes from
    the products of bars, so that no matrix is larger than ``n`` squared.
    """
    top = panel.agg(F.max(by)).first()[0] or 0
    copies = F.sequence(F.floor((F.col(by) + 1) / CHUNK), F.floor((F.col(by) + n) / CHUNK))
    cells = panel.filter(F.col(x).isNotNull()).select(F.explode(copies).alias("chunk"), F.col(by).cast("long").alias("i"), F.col(asset).cast("string").alias("asset"), F.col(x).cast("double").alias("x"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        lo, hi = max(0, chunk * CHUNK - n), min((chunk + 1) * CHUNK - 1, top)
        wide = pdf.pivot_table(index="i", columns="asset", values="x", aggfunc="sum").reindex(range(lo, hi + 1))
        names, m, out = wide.columns.to_numpy(), wide.to_numpy(), []
        for t in range(max(n, chunk * CHUNK), hi + 1):
            if t % every != phase:
                continue
            w = m[t - n - lo : t - lo]
            use = ~np.isnan(w).any(axis=0)
            use[use] = w[:, use].std(axis=0) > 0
            if use.sum() < 2:
                continue
            z = w[:, use] - w[:, use].mean(axis=0)
            z /= np.sqrt((z * z).sum(axis=0))
            tall = z.shape[1] <= n
            lam, vec = np.linalg.eigh(z.T @ z if tall else z @ z.T)
            b = vec[:, -1] if tall else z.T @ vec[:, -1] / np.sqrt(lam[-1])
            b = b * np.sign(b[np.abs(b).argmax()])
            out.append(pd.DataFrame({"t": t, "asset": names[use], "beta": b, "share": lam[-1] / use.sum(), "n_assets": int(use.sum())}))
        empty = {"t": "int64", "asset": "str", "beta": "float64", "share": "float64", "n_assets": "int64"}
        return pd.concat(out) if out else pd.DataFrame({k: pd.Series(dtype=v) for k, v in empty.items()})

    return cells.groupBy("chunk").applyInPandas(solve, "t long, asset string, beta double, share double, n_assets long")


def residual_book(panel: DataFrame, window: int = 180, n: int = 30, k: int = 3, every: int = 24, fee: float = 0.002,
                  by: str = "idx", asset: str = "symbol", x: str = "r") -> DataFrame:
    """Reversal of residuals: (t, gross, net) of a basket that is long the ``k`` assets with the lowest sum of residuals over
    ``n`` bars and short the ``k`` with the highest, held for ``every`` bars.

    The residual is the return less its projection on the first factor of the ``window`` bars before ``t``. The sums over the
    window decide, as the loadings are the same for all of its bars: residual sums are ``S - beta * (beta . S)``.
    """
    first, rows = window + n, (panel.agg(F.max(by)).first()[0] or 0) + 1
    beta = window_loadings(panel, window, every, first % every, by, asset, x).select("t", "asset", "beta")
    cells = panel.select(F.col(by).cast("long").alias("i"), F.col(asset).cast("string").alias("asset"), F.col(x).alias("x"))
    step = lambda v: F.floor(v / every).cast("long")
    due = (F.col("t") >= first) & (F.col("t") < rows - every)
    lo, hi = step(F.col("i") - first + every - 1), step(F.col("i") + n - 1 - first)
    back = cells.withColumn("t", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn("t", F.col("t") * every + first).filter(due)
    sums = back.groupBy("t", "asset").agg(F.sum("x").alias("s")).join(beta, ["t", "asset"])
    common = sums.groupBy("t").agg(F.sum(F.col("beta") * F.col("s")).alias("_dot"))
    signal = sums.join(common, "t").select("t", "asset", (F.col("s") - F.col("beta") * F.col("_dot")).alias("signal"))
    one = F.struct("signal", "asset")
    ends = signal.groupBy("t").agg(F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("low"), F.slice(F.sort_array(F.collect_list(one), False), 1, k).alias("high"))
    legs = ends.select("t", F.explode(F.concat(F.transform("low", lambda s: F.struct(s["asset"].alias("asset"), F.lit(1.0).alias("side"))),
                                               F.transform("high", lambda s: F.struct(s["asset"].alias("asset"), F.lit(-1.0).alias("side"))))).alias("l"))
    ahead = cells.withColumn("t", step(F.col("i") - 1 - first) * every + first).filter(due).groupBy("t", "asset").agg(F.sum("x").alias("ahead"))
    out = legs.select("t", "l.asset", "l.side").join(ahead, ["t", "asset"]).groupBy("t").agg((F.sum(F.col("side") * F.col("ahead")) / k).alias("gross"))
    return out.select("t", "gross", (F.col("gross") - fee).alias("net"))


def share_deciles(panel: DataFrame, pnl: DataFrame, window: int = 180, by: str = "idx", asset: str = "symbol", x: str = "r", r: str = "r") -> DataFrame:
    """Profit per bar by decile of the first factor's share over the bars before it: (decile, n, low, high, mean_pnl, sum_pnl)."""
    from ..operators.selection import wide_quantiles

    share = settled(window_loadings(panel, window, 1, 0, by, asset, x).groupBy("t").agg(F.first("share").alias("share")))
    cuts = wide_quantiles(share, [], "share", {f"c{i}": i / 10 for i in range(1, 10)})
    rank = sum(((F.col("share") >= F.col(f"c{i}")).cast("int") for i in range(1, 10)), F.lit(1))
    both = share.join(pnl.groupBy(F.col(by).alias("t")).agg(F.sum(r).alias("pnl")), "t", "left").crossJoin(F.broadcast(cuts))  # one row of cuts
    return both.withColumns({"decile": rank, "pnl": F.coalesce("pnl", F.lit(0.0))}).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.min("share").alias("low"), F.max("share").alias("high"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("sum_pnl"))
