"""Volatility, trend and volume indicators on frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fold import fold
from ..operators.frames import Frame
from ..operators.kernels import atr_stop, super_trend
from ..operators.recursion import Chain, recur, rma_chain
from ..operators.running import running
from .averages import hlc3, hl2, ma
from .rolling import c, expanding_mean, mean, ratio, std


def true_range_col(f: Frame, drift: int = 1) -> Column:
    prev = f.lag(c("close"), drift)
    wide = F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev))
    return F.when(prev.isNotNull(), wide)


def true_range(f: Frame, drift: int = 1) -> Frame:
    return f.add(true_range=true_range_col(f, drift))


def atr(f: Frame, out: str = "atr", n: int = 14, mode: str = "rma", drift: int = 1, percent: bool = False) -> Frame:
    f = f.add(_tr=true_range_col(f, drift))
    f = ma(f, mode, out, "_tr", n, first=drift, warm=drift)
    # a close of zero gives what a division of doubles gives, not an error
    beyond = F.when(c(out) > 0, F.lit(math.inf)).when(c(out) == 0, F.lit(math.nan))
    return f.add(**{out: F.when(c("close") == 0, beyond).otherwise(100.0 * c(out) / F.nullif("close", F.lit(0.0)))}) if percent else f


def research_atr(f: Frame, out: str = "atr", n: int = 14) -> Frame:
    """Mean true range over what exists: the first bar counts its own range; never zero."""
    prev = F.coalesce(f.lag(c("close")), c("close"))
    f = f.add(_tr=F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)))
    f = f.add(_mtr=expanding_mean(f, "_tr", n))
    return f.add(**{out: F.when(c("_mtr") <= 0, 1e-6).otherwise(c("_mtr"))})


def aberration(f: Frame, n: int = 5, atr_n: int = 15) -> Frame:
    f = atr(f, "atr", atr_n)
    f = f.add(_tp=hlc3())
    f = f.add(zg=mean(f, "_tp", n))
    return f.add(sg=c("zg") + c("atr"), xg=c("zg") - c("atr"))


def accbands(f: Frame, n: int = 20, k: float = 4.0, mode: str = "sma") -> Frame:
    wide = k * ratio(c("high") - c("low"), c("high") + c("low"))
    f = f.add(_lo=c("low") * (1 - wide), _hi=c("high") * (1 + wide))
    f = ma(f, mode, "lower", "_lo", n)
    f = ma(f, mode, "mid", "close", n)
    return ma(f, mode, "upper", "_hi", n)


def bbands(f: Frame, n: int = 20, lower_std: float = 2.0, upper_std: float = 2.0, ddof: int = 1,
           mode: str = "sma") -> Frame:
    f = ma(f, mode, "mid", "close", n)
    f = f.add(_sd=std(f, "close", n, ddof))
    f = f.add(lower=c("mid") - lower_std * c("_sd"), upper=c("mid") + upper_std * c("_sd"))
    width = c("upper") - c("lower")
    return f.add(bandwidth=100.0 * ratio(width, c("mid")), percent_b=ratio(c("close") - c("lower"), width))


def adx(f: Frame, n: int = 14, signal: int | None = None, shift: int = 2, scalar: float = 100.0) -> Frame:
    """Directional movement; only the causal form is offered."""
    signal = signal or n
    f = f.add(_up=c("high") - f.lag(c("high")), _dn=f.lag(c("low")) - c("low"))
    up, dn = c("_up"), c("_dn")
    f = f.add(
        _tr=true_range_col(f),
        _pos=F.when((up > dn) & (up > 0), up).otherwise(0.0),
        _neg=F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
    )
    f = recur(f, [rma_chain(["_atr"], c("_tr"), n, 1), rma_chain(["_p"], c("_pos"), n), rma_chain(["_n"], c("_neg"), n)], 1)
    k = ratio(F.lit(scalar), c("_atr"))
    f = f.add(dmp=k * c("_p"), dmn=k * c("_n"))
    f = f.add(_dx=scalar * ratio(F.abs(c("dmp") - c("dmn")), c("dmp") + c("dmn")))
    # a bar without movement repeats the last index value
    f = running(f, 1, _dxf=("last", c("_dx")))
    f = recur(f, [rma_chain(["adx"], c("_dxf"), signal, n)], 1)
    return f.add(adxr=0.5 * (c("adx") + f.lag(c("adx"), shift)))


def rwi(f: Frame, n: int = 14, mode: str = "rma") -> Frame:
    f = atr(f, "_atr", n, mode)
    unit = c("_atr") * math.sqrt(n)
    return f.add(
        rwi_high=ratio(c("high") - f.lag(c("low"), n), unit), rwi_low=ratio(f.lag(c("high"), n) - c("low"), unit)
    )


def vwma_col(f: Frame, n: int, price: str = "close") -> Column:
    return ratio(mean(f, "_pv", n), mean(f, "volume", n))


def vwma(f: Frame, n: int = 10) -> Frame:
    f = f.add(_pv=c("close") * c("volume"))
    return f.add(vwma=vwma_col(f, n))


def hilo(f: Frame, high_n: int = 13, low_n: int = 21, mode: str = "sma") -> Frame:
    """Follows the low average after a close above the high average, and the reverse."""
    f = ma(f, mode, "_hm", "high", high_n)
    f = ma(f, mode, "_lm", "low", low_n)
    up = c("close") > f.lag(c("_hm"))
    dn = c("close") < f.lag(c("_lm"))
    f = f.add(_way=F.when(up, 1).when(dn, -1))
    f = f.add(_set=F.when(c("_way") == 1, F.coalesce(c("_lm"), F.lit(float("nan"))))
              .when(c("_way") == -1, F.coalesce(c("_hm"), F.lit(float("nan")))))
    f = running(f, max(high_n, low_n), hilo=("last", c("_set")))
    f = f.add(hilo=F.when(~F.isnan("hilo"), c("hilo")))
    return f.add(hilo_long=F.when(c("_way").isNull() | (c("_way") == 1), c("hilo")),
                 hilo_short=F.when(c("_way").isNull() | (c("_way") == -1), c("hilo")))


def supertrend(numbered: DataFrame, n: int = 7, multiplier: float = 3.0, atr_n: int | None = None,
               mode: str = "rma") -> DataFrame:
    f = Frame.of_numbered(numbered, back=max(atr_n or n, 1) + 1)
    f = atr(f, "_atr", atr_n or n, mode)
    bands = f.add(lo=hl2() - multiplier * c("_atr"), hi=hl2() + multiplier * c("_atr")).core(
        "symbol", "idx", "close", "lo", "hi"
    )
    out = fold(bands, super_trend, ["close", "lo", "hi"], {"trend": "double", "side": "double"})
    return out.withColumns({"long": F.when(c("side") > 0, c("trend")), "short": F.when(c("side") < 0, c("trend"))})


def classic_supertrend_side(numbered: DataFrame, n: int = 10, multiplier: float = 3.0) -> DataFrame:
    return supertrend(numbered, n, multiplier).select("symbol", "idx", "side")


def atrts(numbered: DataFrame, n: int = 14, ma_n: int = 20, k: float = 3.0, mode: str = "ema") -> DataFrame:
    f = Frame.of_numbered(numbered, back=max(n, ma_n) + 1)
    f = atr(f, "_atr", n, mode)
    f = ma(f, mode, "avg", "close", ma_n)
    rows = f.add(band=k * c("_atr"), ok=c("idx") >= max(n, ma_n)).core("symbol", "idx", "close", "avg", "band", "ok")
    out = fold(rows, atr_stop, ["close", "avg", "band", "ok"], {"stop": "double", "side": "double"})
    return out.withColumns({"long_stop": F.when(c("side") > 0, c("stop")), "short_stop": F.when(c("side") < 0, c("stop"))})


def ichimoku(f: Frame, tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> Frame:
    """Midpoint lines; ``chikou`` looks ahead (not causal) and needs ``f.ahead >= kijun``."""

    def middle(n: int) -> Column:
        return (f.full(F.max("high"), c("high"), n) + f.full(F.min("low"), c("low"), n)) / 2

    f = f.add(tenkan=middle(tenkan), kijun=middle(kijun), _b=middle(senkou))
    f = f.add(_a=(c("tenkan") + c("kijun")) / 2)
    return f.add(span_a=f.lag(c("_a"), kijun), span_b=f.lag(c("_b"), kijun), chikou=f.lead(c("close"), kijun))


def ichimoku_forward(f: Frame, bar_ms: int, kijun: int = 26) -> DataFrame:
    """The span values of the last ``kijun`` bars of each symbol, dated ``kijun`` bars later."""
    rows = f.core("symbol", "idx", "ts", F.col("_a").alias("span_a"), F.col("_b").alias("span_b"))
    last = rows.groupBy("symbol").agg(F.max("idx").alias("_last"), F.max("ts").alias("_ts"))
    return (
        rows.join(last, "symbol")
        .filter(c("idx") > c("_last") - kijun)
        .select("symbol", (c("idx") + kijun).alias("idx"),
                (c("_ts") + (c("idx") + kijun - c("_last")) * bar_ms).alias("ts"), "span_a", "span_b")
    )


def heikin_ashi(f: Frame) -> Frame:
    """The averaged open is a recursion with coefficient one half."""
    f = f.add(ha_close=(c("open") + c("high") + c("low") + c("close")) / 4)
    half = 0.5 * f.lag(c("ha_close"))
    f = f.add(_b=F.when(c("idx") == 0, 0.5 * (c("open") + c("close"))).otherwise(half))
    f = recur(f, [Chain(("ha_open",), c("_b"), 0.5, 1.0, 0, 0)], 1)
    return f.add(ha_high=F.greatest("ha_open", "ha_close", "high"), ha_low=F.least("ha_open", "ha_close", "low"))


PIVOTS = {
    # name: levels as expressions of tp, o, h, l, c and the range r
    "camarilla": ("(h+l+c)/3", ["c-11/120d*r", "c-11/60d*r", "c-0.275d*r", "c-0.55d*r"],
                  ["c+11/120d*r", "c+11/60d*r", "c+0.275d*r", "c+0.55d*r"]),
    "classic": ("(h+l+c)/3", ["2*tp-h", "tp-r", "tp-2*r", "tp-3*r"], ["2*tp-l", "tp+r", "tp+2*r", "tp+3*r"]),
    "demark": ("CASE WHEN o=c THEN (h+l+2*c)/4 WHEN c>o THEN (2*h+l+c)/4 ELSE (h+2*l+c)/4 END",
               ["2*tp-h", None, None, None], ["2*tp-l", None, None, None]),
    "fibonacci": ("(h+l+c)/3", ["tp-0.382d*r", "tp-0.618d*r", "tp-r", None], ["tp+0.382d*r", "tp+0.618d*r", "tp+r", None]),
    "traditional": ("(h+l+c)/3", ["2*tp-h", "tp-r", "tp-2*r", "tp-2*r"], ["2*tp-l", "tp+r", "tp+2*r", "tp+2*r"]),
    "woodie": ("(2*o+h+l)/4", ["2*tp-h", "tp-r", "l-2*(h-tp)", "l-2*(h-tp)-r"],
               ["2*tp-l", "tp+r", "h+2*(tp-l)", "h+2*(tp-l)+r"]),
}
_ANCHORS = {"D": "day", "W": "week", "M": "month", "Y": "year", "YE": "year"}


def pivots(numbered: DataFrame, method: str = "traditional", anchor: str = "D") -> DataFrame:
    """Levels of the previous day, week, month or year on every bar."""
    period = F.unix_millis(F.date_trunc(_ANCHORS.get(anchor.upper(), "day"), F.timestamp_millis(c("ts"))))
    rows = numbered.withColumn("period", period)
    agg = rows.groupBy("symbol", "period").agg(
        F.min_by("open", "idx").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"),
        F.max_by("close", "idx").alias("c"), F.max("idx").alias("_last"),
    )
    tp, down, up = PIVOTS[method]
    agg = agg.withColumn("r", F.expr("h-l")).withColumn("tp", F.expr(tp))
    names = {f"s{i + 1}": e for i, e in enumerate(down)} | {f"r{i + 1}": e for i, e in enumerate(up)}
    levels = agg.select("symbol", "period", "_last", c("tp").alias("p"),
                        *[(F.expr(e) if e else F.lit(None)).cast("double").alias(n) for n, e in names.items()])
    # each period's levels belong to the bar after its last bar, hence to the next period present
    nxt = rows.select("symbol", "idx", c("period").alias("_p"))
    after = levels.withColumn("idx", c("_last") + 1).join(nxt, ["symbol", "idx"]).select(
        "symbol", c("_p").alias("period"), "p", *names
    )
    return rows.join(after, ["symbol", "period"], "left").drop("period")
