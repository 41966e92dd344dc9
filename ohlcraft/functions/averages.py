"""Moving averages. ``x`` names the input column, ``first`` the ordinal of its first
valid value and ``warm`` how many rows of look-back it already carries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.frames import Frame
from ..operators.recursion import Chain, ema_chain, recur, recur_varying, rma_chain
from . import weights as W
from .rolling import c, dot, mean, ratio, rolling_max, rolling_min, rolling_sum


def sma(f: Frame, out: str, x: str = "close", n: int = 10, **_) -> Frame:
    return f.add(**{out: mean(f, x, n)})


def ema(f: Frame, out: str, x: str = "close", n: int = 10, first: int = 0, warm: int = 0) -> Frame:
    return recur(f, [ema_chain([out], c(x), n, first)], warm)


def rma(f: Frame, out: str, x: str = "close", n: int = 10, first: int = 0, warm: int = 0) -> Frame:
    return recur(f, [rma_chain([out], c(x), n, first)], warm)


smma = rma


def dema(f: Frame, out: str, x: str = "close", n: int = 10, first: int = 0, warm: int = 0) -> Frame:
    f = recur(f, [ema_chain(["_d1", "_d2"], c(x), n, first)], warm)
    return f.add(**{out: 2 * c("_d1") - c("_d2")})


def tema(f: Frame, out: str, x: str = "close", n: int = 10, first: int = 0, warm: int = 0) -> Frame:
    f = recur(f, [ema_chain(["_t1", "_t2", "_t3"], c(x), n, first)], warm)
    return f.add(**{out: 3 * (c("_t1") - c("_t2")) + c("_t3")})


def t3(f: Frame, out: str, x: str = "close", n: int = 10, first: int = 0, warm: int = 0, a: float = 0.7) -> Frame:
    f = recur(f, [ema_chain([f"_t{k}" for k in range(1, 7)], c(x), n, first)], warm)
    w6, w5 = -(a**3), 3 * a**2 + 3 * a**3
    w4, w3 = -6 * a**2 - 3 * a - 3 * a**3, 1 + 3 * a + 3 * a**2 + a**3
    return f.add(**{out: w6 * c("_t6") + w5 * c("_t5") + w4 * c("_t4") + w3 * c("_t3")})


def weighted(weigh):
    def average(f: Frame, out: str, x: str = "close", n: int = 10, first: int = 0, warm: int = 0, **kw) -> Frame:
        return f.add(**{out: dot(f, x, weigh(n, **kw))})

    return average


wma = weighted(W.linear)
fwma = weighted(W.fibonacci)
pwma = weighted(W.pascal)
sinwma = weighted(W.sine)
swma = weighted(W.triangle)


def alma(f: Frame, out: str, x: str = "close", n: int = 9, sigma: float = 6.0, offset: float = 0.85, **_) -> Frame:
    return f.add(**{out: dot(f, x, W.gauss(n, sigma, offset))})


def trima(f: Frame, out: str, x: str = "close", n: int = 10, **_) -> Frame:
    half = (n + 1) // 2 if n % 2 else n // 2
    f = f.add(_tr=mean(f, x, half))
    return f.add(**{out: mean(f, "_tr", half if n % 2 else half + 1)})


def hma(f: Frame, out: str, x: str = "close", n: int = 10, mode: str = "wma", first: int = 0, warm: int = 0) -> Frame:
    root = int(math.sqrt(n))
    f = ma(f, mode, "_h1", x, n // 2, first=first, warm=warm)
    f = ma(f, mode, "_h2", x, n, first=first, warm=warm)
    f = f.add(_hd=2 * c("_h1") - c("_h2"))
    return ma(f, mode, out, "_hd", root, first=first + n - 1, warm=warm + n - 1)


def _window_index(f: Frame, n: int) -> Column:
    return c("idx").cast("double")


def linreg(f: Frame, out: str, x: str = "close", n: int = 14, mode: str = "line", degrees: bool = False, **_) -> Frame:
    """Least squares of the window on 1..n."""
    sx, sxx = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    div = n * sxx - sx * sx
    f = f.add(
        _sy=rolling_sum(f, x, n),
        _sxy=dot(f, x, [float(i) for i in range(1, n + 1)]),
    )
    slope = (n * c("_sxy") - sx * c("_sy")) / div
    intercept = (c("_sy") - slope * sx) / n
    if mode == "slope":
        value = slope
    elif mode == "intercept":
        value = intercept
    elif mode == "angle":
        value = F.atan(slope) * (180 / math.pi if degrees else 1.0)
    elif mode == "r":
        f = f.add(_sq=c(x) * c(x))
        f = f.add(_syy=rolling_sum(f, "_sq", n))
        square = div * (n * c("_syy") - c("_sy") * c("_sy"))
        spread = F.when(square.isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0))))
        value = ratio(n * c("_sxy") - sx * c("_sy"), spread, F.lit(0.0))
    else:
        value = slope * (n + 1.0 if mode == "tsf" else float(n)) + intercept
    return f.add(**{out: value})


def midpoint(f: Frame, out: str, x: str = "close", n: int = 2, **_) -> Frame:
    return f.add(**{out: (rolling_max(f, x, n) + rolling_min(f, x, n)) / 2})


def midprice(f: Frame, out: str, n: int = 2, **_) -> Frame:
    return f.add(**{out: (rolling_max(f, "high", n) + rolling_min(f, "low", n)) / 2})


def hl2() -> Column:
    return (c("high") + c("low")) / 2


def hlc3() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def ohlc4() -> Column:
    return (c("open") + c("high") + c("low") + c("close")) / 4


def wcp() -> Column:
    return (c("high") + c("low") + 2 * c("close")) / 4


def kama(f: Frame, out: str, x: str = "close", n: int = 10, fast: int = 2, slow: int = 30, first: int = 0,
         warm: int = 0) -> Frame:
    """Efficiency-ratio adaptive average, seeded by the mean of the first n values."""
    fr, sr = 2 / (fast + 1), 2 / (slow + 1)
    f = f.add(_d1=F.coalesce(F.abs(c(x) - f.lag(c(x))), F.lit(0.0)), _dn=F.abs(c(x) - f.lag(c(x), n)))
    f = f.add(_path=F.sum("_d1").over(f.rows(n)), _seed=mean(f, x, n))
    er = ratio(c("_dn"), c("_path"), F.lit(0.0))
    f = f.add(_sc=F.pow(er * (fr - sr) + sr, 2.0))
    start = first + n - 1
    b = F.when(c("idx") == start, c("_seed")).otherwise(c("_sc") * c(x))
    floor_a = 1 - fr**2
    return recur_varying(f, out, 1 - c("_sc"), b, start, floor_a, warm + n)


def vidya(f: Frame, out: str, x: str = "close", n: int = 14, drift: int = 1, first: int = 0, warm: int = 0) -> Frame:
    """Momentum-scaled average, seeded by the close at the first full momentum window."""
    alpha = 2 / (n + 1)
    f = f.add(_d=c(x) - f.lag(c(x), drift))
    f = f.add(_up=F.greatest(c("_d"), F.lit(0.0)), _dn=F.greatest(-c("_d"), F.lit(0.0)))
    f = f.add(_su=rolling_sum(f, "_up", n), _sd=rolling_sum(f, "_dn", n))
    f = f.add(_k=alpha * F.abs(ratio(c("_su") - c("_sd"), c("_su") + c("_sd"), F.lit(0.0))))
    start = first + n + drift - 1
    b = F.when(c("idx") == start, c(x)).otherwise(c("_k") * c(x))
    return recur_varying(f, out, 1 - c("_k"), b, start, 1 - alpha, warm + n + drift - 1)


def zlma(f: Frame, out: str, x: str = "close", n: int = 10, mode: str = "ema", first: int = 0, warm: int = 0) -> Frame:
    """Average of the lag-corrected series; the head of that series repeats its first value."""
    lag = (n - 1) // 2
    f = f.add(_zl=2 * c(x) - f.lag(c(x), lag))
    head = F.first("_zl", ignorenulls=True).over(f.w.rowsBetween(0, lag))
    f = f.add(_zl=F.when(c("idx") < first + lag, head).otherwise(c("_zl")))
    return ma(f, mode, out, "_zl", n, first=first, warm=warm + lag)


MODES = {
    "sma": sma, "ema": ema, "rma": rma, "smma": smma, "wma": wma, "dema": dema, "tema": tema, "t3": t3,
    "trima": trima, "hma": hma, "alma": alma, "fwma": fwma, "pwma": pwma, "sinwma": sinwma, "swma": swma,
    "linreg": linreg, "kama": kama, "vidya": vidya, "zlma": zlma, "midpoint": midpoint,
}


def ma(f: Frame, mode: str, out: str, x: str, n: int, first: int = 0, warm: int = 0) -> Frame:
    """Average by name; an unknown name means the exponential one."""
    return MODES.get(mode.lower(), ema)(f, out, x, n, first=first, warm=warm)
