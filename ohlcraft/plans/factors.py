"""Factor share, tail correlation, carry books, option overlay and other portfolio studies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import c, ratio
from ..operators.fold import fold
from ..operators.frames import Frame
from ..operators.selection import wide_quantiles
from ..operators.states import dead_zone, one_sided, states


def tail_rows(panel: DataFrame, by: str, x: str, q: float = 0.05) -> DataFrame:
    """Bars whose mean over the assets is in the worst ``q``."""
    m = panel.groupBy(by).agg(F.avg(x).alias("_m"))
    cut = wide_quantiles(m, [], "_m", {"_q": q})
    return panel.join(m.crossJoin(F.broadcast(cut)).filter("_m <= _q").select(by), by, "left_semi")


def factor_distance(panel: DataFrame, by: str, asset: str, x: str) -> DataFrame:
    """One minus the absolute correlation of each asset with the equal-weight mean."""
    m = panel.groupBy(by).agg(F.avg(x).alias("_m"))
    return panel.join(m, by).groupBy(asset).agg((1 - F.abs(F.corr(x, "_m"))).alias("distance"))


def rolling_share(panel: DataFrame, n: int, every: int, by: str = "idx", asset: str = "symbol", x: str = "r") -> DataFrame:
    """First eigenvalue share over trailing windows of ``n`` bars, one window per ``every`` bars.

    Each window is one group of ``n`` × assets numbers; windows are independent tasks.
    """
    last = panel.agg(F.max(by).alias("_l"))
    # windows that contain this bar end at multiples of `every` in [bar, bar + n - 1]
    lo = F.greatest(F.ceil(c(by) / every), F.lit(-(-(n - 1) // every)))
    hi = F.floor((c(by) + n - 1) / every)
    w = panel.crossJoin(F.broadcast(last)).withColumn("end", F.explode(F.when(hi >= lo, F.sequence(lo, hi)))).withColumn("end", c("end") * every).filter("end <= _l")

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=by, columns=asset, values=x).dropna(axis=1)
        wide = wide.loc[:, wide.std() > 0]
        value = None
        if wide.shape[1] > 1 and wide.shape[0] > 2:
            lam = np.linalg.eigvalsh(np.corrcoef(wide.to_numpy(), rowvar=False))
            value = float(lam[-1] / lam.sum())
        return pd.DataFrame({"end": [int(pdf["end"].iloc[0])], "n_assets": [int(wide.shape[1])], "share": [value]})

    return w.select("end", by, asset, x).groupBy("end").applyInPandas(share, "end long, n_assets long, share double")


# -- carry ------------------------------------------------------------------
def trailing_signal(f: Frame, x: str = "rate", n: int = 3) -> Frame:
    """Mean of the ``n`` days before this one."""
    return f.add(signal=f.full(F.avg(x), c(x), n, 1))


def slow_carry(rows: DataFrame, enter: float, leave: float, cost: float) -> DataFrame:
    """Carry position with hysteresis on the trailing signal, charged on changes."""
    held = states(rows, one_sided(c("signal"), enter, leave), "pos", "_was")
    return held.select(*rows.columns, c("pos").cast("double").alias("pos"), (c("pos") * F.coalesce("rate", F.lit(0.0)) - cost * F.abs(c("pos") - c("_was"))).alias("r"))


def two_sided_carry(rows: DataFrame, zone: float = 0.0002, round_trip: float = 0.002) -> DataFrame:
    """Net carry per bar: short (-1) on a positive signal, long (1) on a negative one, flat once the signal changes sign.

    Half a round trip is paid on the bar of each entry and exit. Bars without a rate are skipped and earn nothing.
    """
    held = states(rows, dead_zone(c("rate"), c("signal"), zone), "pos", "_was")
    cost = F.when(c("pos") != c("_was"), round_trip / 2).otherwise(0.0)
    return held.select(*rows.columns, "pos", F.when(c("rate").isNull(), 0.0).otherwise(-c("pos") * c("rate") - cost).alias("r"))


def _fills(limit: float, give_up: int):
    def run(a, state):
        want, u = a["want"], a["u"]
        held, waiting = state if state else (0.0, 0.0)
        out = np.zeros(len(want))
        for i in range(len(want)):
            if want[i] != held:
                waiting += 1
                if u[i] < limit or waiting > give_up:
                    held, waiting = float(want[i]), 0.0
            else:
                waiting = 0.0
            out[i] = held
        return {"held": out}, [held, waiting]

    return run


def random_fills(rows: DataFrame, limit: float = 0.6, give_up: int = 3) -> DataFrame:
    """A wanted position filled with probability ``limit`` per bar, by force after ``give_up`` misses; ``u`` is hashed."""
    return fold(rows, _fills(limit, give_up), ["want", "u"], {"held": "double"}, keep=["want"])


# -- options ----------------------------------------------------------------
# fixed values: Hart's rational approximation of the normal distribution function, highest power first
PHI_TOP = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
PHI_BOTTOM = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
PHI_FAR, PHI_ROOT = 7.07106781186547, 2.506628274631


def normal_cdf(x: Column) -> Column:
    """Normal distribution function to about 15 digits: a ratio of polynomials, and a continued fraction far out."""
    a = F.abs(x)

    def polynomial(factors: list[float]) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * a + f
        return out

    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(k) / far
    tail = F.exp(-a * a / 2) * F.when(a < PHI_FAR, polynomial(PHI_TOP) / polynomial(PHI_BOTTOM)).otherwise(1 / (far * PHI_ROOT))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def put_value(spot: Column, strike: Column, years: Column, vol: Column) -> Column:
    """European put without rates; the intrinsic value at or after expiry and where spot or strike isn't positive."""
    sd = vol * F.sqrt(F.greatest(years, F.lit(1e-12)))
    d1 = F.log(spot / F.nullif(strike, F.lit(0.0))) / sd + sd / 2
    return F.when((years <= 0) | (vol <= 0) | (spot <= 0) | (strike <= 0), F.greatest(strike - spot, F.lit(0.0))).otherwise(strike * normal_cdf(sd - d1) - spot * normal_cdf(-d1))


def nearest_strike(want: DataFrame, chain: DataFrame, share: float = 0.9) -> DataFrame:
    """First expiry at or after the horizon with the strike nearest to ``share`` of spot.

    ``want``: ``day, need, spot``; ``chain``: ``day, expiry, strike``. Chains meet by day, a bounded list each.
    """
    j = want.join(chain, "day").filter(c("expiry") >= c("need"))
    first = j.groupBy("day", "need", "spot").agg(F.min("expiry").alias("expiry"))
    k = j.join(first, ["day", "need", "spot", "expiry"])
    best = F.min_by("strike", F.struct(F.abs(c("strike") - share * c("spot")).alias("gap"), c("strike")))
    return k.groupBy("day", "need", "spot", "expiry").agg(best.alias("strike"))


# -- other studies ----------------------------------------------------------
def below_average(f: Frame, n: int = 200) -> Frame:
    avg = f.full(F.avg("close"), c("close"), n)
    return f.add(below=F.coalesce(c("close") < avg, F.lit(False)))


def fractal_structure(f: Frame) -> Frame:
    """Trend from the last two fractal highs and lows, each known two bars later."""
    from ..operators.running import running

    hi = (c("high") > f.lag(c("high"), 1)) & (c("high") > f.lag(c("high"), 2)) & (c("high") > f.lead(c("high"), 1)) & (c("high") > f.lead(c("high"), 2))
    lo = (c("low") < f.lag(c("low"), 1)) & (c("low") < f.lag(c("low"), 2)) & (c("low") < f.lead(c("low"), 1)) & (c("low") < f.lead(c("low"), 2))
    f = f.add(_fh=F.when(hi, c("high")), _fl=F.when(lo, c("low")))
    f = f.add(_kh=f.lag(c("_fh"), 2), _kl=f.lag(c("_fl"), 2))
    f = running(f, 5, _h1=("last", c("_kh")), _l1=("last", c("_kl"))).settle()
    # the one before: the carried value just before the last event
    f = f.add(_ph=F.when(c("_kh").isNotNull(), f.lag(c("_h1"))), _pl=F.when(c("_kl").isNotNull(), f.lag(c("_l1"))))
    f = running(f, 6, _h0=("last", F.when(c("_kh").isNotNull(), F.coalesce("_ph", F.lit(float("nan"))))), _l0=("last", F.when(c("_kl").isNotNull(), F.coalesce("_pl", F.lit(float("nan"))))))
    known = ~F.isnan("_h0") & ~F.isnan("_l0")
    up, dn = known & (c("_h1") > c("_h0")) & (c("_l1") > c("_l0")), known & (c("_h1") < c("_h0")) & (c("_l1") < c("_l0"))
    return f.add(structure=F.when(up, 1).when(dn, -1).otherwise(0))


def vol_regime(f: Frame, n: int = 30, med: int = 90) -> Frame:
    """Size multiplier: half when realised volatility is above its trailing median."""
    f = f.add(_lr=F.log(c("close") / F.nullif(f.lag(c("close")), F.lit(0.0))))
    f = f.add(rv=f.full(F.stddev_pop("_lr"), c("_lr"), n))
    f = f.add(_md=f.full(F.percentile("rv", 0.5), c("rv"), med))
    return f.add(mult=F.when(c("rv") > c("_md"), 0.5).otherwise(1.0))


def half_life(rows: DataFrame, x: str, prev: str, by: list[str]) -> DataFrame:
    """AR(1) slope and the number of bars in which a deviation halves."""
    a = rows.filter(c(prev).isNotNull()).groupBy(*by).agg(F.regr_slope(x, prev).alias("b"))
    return a.select(*by, "b", F.when((c("b") > 0) & (c("b") < 1), -F.log(F.lit(2.0)) / F.log("b")).alias("half_life"))


def denoise(f: Frame, n: int = 30, rank: int = 3, out: str = "smooth") -> Frame:
    """Last point of each window after keeping ``rank`` components of its trajectory matrix."""
    half = n // 2

    @F.pandas_udf("double")
    def last_point(col: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            v = np.asarray(v, dtype=float)
            m = np.lib.stride_tricks.sliding_window_view(v, half)
            u, s, vt = np.linalg.svd(m, full_matrices=False)
            return float((u[-1, :rank] * s[:rank]) @ vt[:rank, -1])

        return col.map(one)

    f = f.add(_win=f.full(F.collect_list("close"), c("close"), n))
    return f.add(**{out: last_point(c("_win"))})
