"""Momentum indicators on frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.frames import Frame
from ..operators.recursion import Chain, ema_chain, recur, rma_chain
from ..operators.running import running
from .averages import ema, hl2, hlc3, linreg, ma, ohlc4, wma
from .rolling import c, dot, mean, ratio, rolling_max, rolling_min, rolling_sum, values


def head_fill(f: Frame, x: str, first: int) -> Column:
    """The series with its missing head replaced by its first valid value."""
    head = F.first(x, ignorenulls=True).over(f.w.rowsBetween(0, max(first, 1)))
    return F.when(c("idx") < first, head).otherwise(c(x))


def signal_ema(f: Frame, out: str, x: str, n: int, first: int, blank: int, warm: int) -> Frame:
    """EMA over the head-filled series, hidden before ordinal ``blank``."""
    f = f.add(_sg=head_fill(f, x, first))
    f = ema(f, "_se", "_sg", n, warm=warm)
    return f.add(**{out: F.when(c("idx") >= blank, c("_se"))})


def ao(f: Frame, fast: int = 5, slow: int = 34) -> Frame:
    fast, slow = sorted((fast, slow))
    f = f.add(_m=hl2())
    return f.add(ao=mean(f, "_m", fast) - mean(f, "_m", slow))


def apo(f: Frame, fast: int = 12, slow: int = 26, mode: str = "sma") -> Frame:
    fast, slow = sorted((fast, slow))
    f = ma(ma(f, mode, "_f", "close", fast), mode, "_s", "close", slow)
    return f.add(apo=c("_f") - c("_s"))


def bias(f: Frame, n: int = 26, mode: str = "sma") -> Frame:
    f = ma(f, mode, "_m", "close", n)
    return f.add(bias=ratio(c("close"), c("_m")) - 1)


def bop(f: Frame, scalar: float = 1.0) -> Frame:
    return f.add(bop=ratio(scalar * (c("close") - c("open")), c("high") - c("low"), F.lit(0.0)))


def brar(f: Frame, n: int = 26, scalar: float = 100.0, drift: int = 1) -> Frame:
    prev = f.lag(c("close"), drift)
    f = f.add(_ho=c("high") - c("open"), _ol=c("open") - c("low"),
              _hc=F.when(prev.isNotNull(), F.greatest(c("high") - prev, F.lit(0.0))),
              _cl=F.when(prev.isNotNull(), F.greatest(prev - c("low"), F.lit(0.0))))
    f = f.add(**{"_s" + k: rolling_sum(f, k, n) for k in ("_ho", "_ol", "_hc", "_cl")})
    return f.add(ar=scalar * ratio(c("_s_ho"), c("_s_ol")), br=scalar * ratio(c("_s_hc"), c("_s_cl")))


def cci(f: Frame, n: int = 14, k: float = 0.015) -> Frame:
    f = f.add(_tp=hlc3())
    f = f.add(_m=mean(f, "_tp", n), _a=values(f, "_tp", n))
    mad = F.aggregate("_a", F.lit(0.0), lambda s, v: s + F.abs(v - c("_m"))) / n
    return f.add(cci=ratio(c("_tp") - c("_m"), k * mad))


def cfo(f: Frame, n: int = 9, scalar: float = 100.0) -> Frame:
    f = linreg(f, "_tsf", "close", n, mode="tsf")
    return f.add(cfo=ratio(scalar * (c("close") - c("_tsf")), c("close")))


def cg(f: Frame, n: int = 10) -> Frame:
    f = f.add(_num=dot(f, "close", [float(k) for k in range(1, n + 1)]), _den=rolling_sum(f, "close", n))
    return f.add(cg=ratio(-c("_num"), c("_den")))


def cmo(f: Frame, n: int = 14, scalar: float = 100.0, drift: int = 1) -> Frame:
    f = f.add(_d=c("close") - f.lag(c("close"), drift))
    f = f.add(_up=F.greatest("_d", F.lit(0.0)), _dn=F.greatest(-c("_d"), F.lit(0.0)))
    f = f.add(_su=rolling_sum(f, "_up", n), _sd=rolling_sum(f, "_dn", n))
    return f.add(cmo=scalar * ratio(c("_su") - c("_sd"), c("_su") + c("_sd")))


def roc_of(f: Frame, n: int, x: str = "close", scalar: float = 100.0) -> Column:
    prev = f.lag(c(x), n)
    return ratio(scalar * (c(x) - prev), prev)


def roc(f: Frame, n: int = 10, scalar: float = 100.0) -> Frame:
    return f.add(roc=roc_of(f, n, scalar=scalar))


def coppock(f: Frame, fast: int = 11, slow: int = 14, n: int = 10) -> Frame:
    f = f.add(_r=roc_of(f, fast) + roc_of(f, slow))
    return wma(f, "coppock", "_r", n)


def rsi_of(f: Frame, out: str, x: str = "close", n: int = 14, scalar: float = 100.0, drift: int = 1, first: int = 0,
           warm: int = 0) -> Frame:
    """Wilder RSI; the average gains start at the first bar, whose change counts as zero."""
    f = f.add(_d=c(x) - f.lag(c(x), drift))
    known = c("idx") >= first + drift
    gain = F.when(~known, 0.0).otherwise(F.greatest("_d", F.lit(0.0)))
    loss = F.when(~known, 0.0).otherwise(F.greatest(-c("_d"), F.lit(0.0)))
    f = recur(f, [rma_chain(["_g"], F.when(c("idx") >= first, gain), n, first),
                  rma_chain(["_l"], F.when(c("idx") >= first, loss), n, first)], warm + drift)
    g, l = c("_g"), c("_l")
    value = (
        F.when((g == 0) & (l == 0), F.lit(None))
        .when(g == 0, F.lit(0.0))
        .when(l == 0, F.lit(scalar))
        .otherwise(scalar - scalar / (1 + g / F.when(l != 0, l)))
    )
    return f.add(**{out: value})


def rsi(f: Frame, n: int = 14, scalar: float = 100.0, drift: int = 1) -> Frame:
    return rsi_of(f, "rsi", "close", n, scalar, drift)


def streak(f: Frame, out: str, x: str = "close", warm: int = 1) -> Frame:
    """Signed length of the run of rises or falls ending here."""
    f = f.add(_sd=F.coalesce(F.signum(c(x) - f.lag(c(x))), F.lit(0.0)))
    f = f.add(_brk=F.when(c("_sd") != F.coalesce(f.lag(c("_sd")), F.lit(9.0)), c("idx")))
    f = running(f, warm + 1, _at=("last", c("_brk")))
    return f.add(**{out: c("_sd") * (c("idx") - c("_at") + 1)})


def crsi(f: Frame, n: int = 3, streak_n: int = 2, rank_n: int = 100, scalar: float = 100.0) -> Frame:
    f = rsi_of(f, "_r1", "close", n, scalar)
    f = streak(f, "streak").settle()
    f = rsi_of(f, "_r2", "streak", streak_n, scalar, warm=2)
    f = f.add(_a=values(f, "close", rank_n))
    rank = F.size(F.filter("_a", lambda v: v < c("close"))) / (rank_n - 1) * 100.0
    return f.add(crsi=(c("_r1") + c("_r2") + F.when(c("_a").isNotNull(), rank)) / 3.0)


def er(f: Frame, n: int = 10) -> Frame:
    f = f.add(_d=F.abs(c("close") - f.lag(c("close"))))
    return f.add(er=ratio(F.abs(c("close") - f.lag(c("close"), n)), rolling_sum(f, "_d", n)))


def fisher(f: Frame, n: int = 9) -> Frame:
    f = f.add(_hi=rolling_max(f, "high", n), _lo=rolling_min(f, "low", n))
    f = f.add(_p=0.66 * (ratio(hlc3() - c("_lo"), c("_hi") - c("_lo")) - 0.5))
    f = recur(f, [Chain(("_raw",), c("_p"), 0.67, 1.0, 0, n - 1)], n - 1)
    f = recur(f, [Chain(("_val",), 0.5 * c("_raw"), 0.5, 1.0, 0, n - 1)], n - 1)
    f = f.add(fisher=0.5 * F.log((1 + c("_val")) / (1 - c("_val"))))
    return f.add(signal=f.lag(c("fisher")))


def kst(f: Frame, rocs=(10, 15, 20, 30), smooth=(10, 10, 10, 15), signal: int = 9) -> Frame:
    f = f.add(**{f"_k{i}": roc_of(f, r) for i, r in enumerate(rocs)})
    total = F.lit(0.0)
    for i, n in enumerate(smooth):
        total = total + (i + 1.0) * mean(f, f"_k{i}", n)
    f = f.add(kst=total)
    return f.add(signal=mean(f, "kst", signal))


def macd_of(f: Frame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, percent: bool = False,
            scalar: float = 100.0, line: str = "macd", warm: int = 0) -> Frame:
    f = recur(f, [ema_chain(["_f"], c(x), fast), ema_chain(["_s"], c(x), slow)], warm)
    spread = c("_f") - c("_s")
    f = f.add(**{line: scalar * ratio(spread, c("_s")) if percent else spread})
    f = signal_ema(f, "signal", line, signal, slow - 1, slow + signal - 2, warm)
    return f.add(hist=c(line) - c("signal"))


def macd(f: Frame, fast: int = 12, slow: int = 26, signal: int = 9) -> Frame:
    return macd_of(f, "close", fast, slow, signal)


def macd_as(f: Frame, fast: int = 12, slow: int = 26, signal: int = 9) -> Frame:
    """The variant that runs the signal over the histogram."""
    f = macd_of(f, "close", fast, slow, signal)
    f = f.add(macd=c("hist")).settle()
    f = signal_ema(f, "signal", "macd", signal, slow + signal - 2, slow + signal - 2, 0)
    return f.add(hist=c("macd") - c("signal"))


def ppo(f: Frame, fast: int = 12, slow: int = 26, signal: int = 9, scalar: float = 100.0) -> Frame:
    return macd_of(f, "close", fast, slow, signal, percent=True, scalar=scalar, line="ppo")


def pgo(f: Frame, n: int = 14) -> Frame:
    f = ema(f, "_e", "close", n)
    return f.add(pgo=ratio(c("close") - c("_e"), rolling_max(f, "high", n) - rolling_min(f, "low", n)))


def psl(f: Frame, n: int = 12, drift: int = 1) -> Frame:
    f = f.add(_u=(c("close") > f.lag(c("close"), drift)).cast("double"))
    return f.add(psl=100.0 * mean(f, "_u", n))


def stoch_of(f: Frame, x: str, n: int) -> Column:
    lo, hi = rolling_min(f, x, n), rolling_max(f, x, n)
    return ratio(100.0 * (c(x) - lo), hi - lo)


def stc(f: Frame, n: int = 10, fast: int = 12, slow: int = 26, factor: int = 3) -> Frame:
    f = recur(f, [ema_chain(["_f"], c("close"), fast), ema_chain(["_s"], c("close"), slow)])
    f = f.add(macd=c("_f") - c("_s"))
    at = slow - 1 + n - 1
    f = f.add(_k=stoch_of(f, "macd", n))
    f = signal_ema(f, "stoch", "_k", factor, at, at + factor - 1, n - 1)
    at2 = at + factor - 1 + n - 1
    f = f.settle().add(_k2=stoch_of(f, "stoch", n))
    return signal_ema(f, "stc", "_k2", factor, at2, at2 + factor - 1, 2 * (n - 1))


def stoch(f: Frame, k: int = 14, d: int = 3, smooth: int = 3, mode: str = "sma") -> Frame:
    lo, hi = rolling_min(f, "low", k), rolling_max(f, "high", k)
    f = f.add(_raw=ratio(100.0 * (c("close") - lo), hi - lo))
    f = ma(f, mode, "stoch_k", "_raw", smooth, first=k - 1, warm=k - 1)
    return ma(f, mode, "stoch_d", "stoch_k", d, first=k + smooth - 2, warm=k + smooth - 2)


def stochf(f: Frame, k: int = 14, d: int = 3, mode: str = "sma") -> Frame:
    lo, hi = rolling_min(f, "low", k), rolling_max(f, "high", k)
    f = f.add(stoch_k=ratio(100.0 * (c("close") - lo), hi - lo))
    return ma(f, mode, "stoch_d", "stoch_k", d, first=k - 1, warm=k - 1)


def stochrsi(f: Frame, n: int = 14, rsi_n: int = 14, k: int = 3, d: int = 3, mode: str = "sma") -> Frame:
    f = rsi_of(f, "_rsi", "close", rsi_n)
    lo, hi = rolling_min(f, "_rsi", n), rolling_max(f, "_rsi", n)
    f = f.add(_st=ratio(100.0 * (c("_rsi") - lo), hi - lo, F.lit(50.0)), _n=F.count("_rsi").over(f.rows(n)))
    # an incomplete window is neutral, like a flat one
    f = f.add(_st=F.when(c("_n") < n, F.lit(None)).otherwise(c("_st")))
    f = ma(f, mode, "stoch_k", "_st", k, first=n + rsi_n - 2, warm=n)
    return ma(f, mode, "stoch_d", "stoch_k", d, first=n + rsi_n + k - 3, warm=n + k - 1)


def tmo(f: Frame, n: int = 14, drift: int = 1, smooth: int = 4, normalize: bool = True) -> Frame:
    f = f.add(_d=c("open") - f.lag(c("close"), drift))
    f = f.add(_m=rolling_sum(f, "_d", n))
    first = n + drift - 1
    f = signal_ema(f, "_sgn", "_m", smooth, first, first + smooth - 1, first)
    scale = 100.0 / n if normalize else 1.0
    return f.add(tmo=c("_m") * scale, signal=c("_sgn") * scale)


def tsi(f: Frame, long: int = 25, short: int = 13, signal: int = 13) -> Frame:
    f = f.add(_m=c("close") - f.lag(c("close")))
    f = f.add(_a=F.abs("_m"))
    f = f.add(_m=head_fill(f, "_m", 1), _a=head_fill(f, "_a", 1))
    f = recur(f, [ema_chain(["_m1"], c("_m"), short), ema_chain(["_a1"], c("_a"), short)], 1)
    at = short  # first valid first-stage value
    hide = c("idx") >= at
    f = f.add(_m1=F.when(hide, c("_m1")), _a1=F.when(hide, c("_a1")))
    f = f.add(_m1=head_fill(f, "_m1", at), _a1=head_fill(f, "_a1", at))
    f = recur(f, [ema_chain(["_m2"], c("_m1"), long), ema_chain(["_a2"], c("_a1"), long)], 1)
    first = at + long - 1
    f = f.settle().add(tsi=F.when(c("idx") >= first, ratio(100.0 * c("_m2"), c("_a2"))))
    return signal_ema(f, "signal", "tsi", signal, first, long + short + signal - 2, 1)


def uo(f: Frame, fast: int = 7, medium: int = 14, slow: int = 28) -> Frame:
    prev = f.lag(c("close"))
    low = F.when(prev.isNotNull(), F.least("low", prev))
    high = F.when(prev.isNotNull(), F.greatest("high", prev))
    f = f.add(_bp=c("close") - low, _tr=high - low)

    def part(n: int) -> Column:
        return ratio(rolling_sum(f, "_bp", n), rolling_sum(f, "_tr", n))

    return f.add(uo=100.0 * (4 * part(fast) + 2 * part(medium) + part(slow)) / 7.0)


def willr(f: Frame, n: int = 14) -> Frame:
    hi, lo = rolling_max(f, "high", n), rolling_min(f, "low", n)
    return f.add(willr=ratio(-100.0 * (hi - c("close")), hi - lo))


def rsi_clouds(f: Frame, n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> Frame:
    """MACD of the RSI of the bar average."""
    f = f.add(_avg=ohlc4())
    f = rsi_of(f, "rsi", "_avg", n)
    at = n - 1
    f = f.settle()
    f = recur(f, [ema_chain(["_f"], c("rsi"), fast, at), ema_chain(["_s"], c("rsi"), slow, at)], 1)
    f = f.add(macd=c("_f") - c("_s"))
    f = ema(f, "signal", "macd", signal, first=at + slow - 1, warm=1)
    return f.add(hist=c("macd") - c("signal"))
