"""Volume-weighted support and resistance lines and the other custom indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import SIZE, Frame
from ..operators.recursion import Chain, recur, recur_varying
from ..operators.running import running, two_state
from ..sources.store import settled
from .averages import ema, linreg, sma, wma
from .rolling import c, mean, ratio, rolling_sum
from .volatility import vwma_col


def avs_base(f: Frame, fast: int, slow: int, stand_div: float = 1.0) -> Frame:
    f = f.add(_pv=c("close") * c("volume"))
    f = f.add(_wf=vwma_col(f, fast), _ws=vwma_col(f, slow), _sf=mean(f, "close", fast), _ss=mean(f, "close", slow),
              _vf=mean(f, "volume", fast), _vs=mean(f, "volume", slow))
    f = f.add(vpc=c("_ws") - c("_ss"), vpr=ratio(c("_wf"), c("_sf")), vm=ratio(c("_vf"), c("_vs")))
    f = f.add(vpci=c("vpc") * c("vpr") * c("vm"))
    return f.add(dev=stand_div * c("vpci") * c("vm"))


def _segment_mean(f: Frame, price: str) -> DataFrame:
    """Rows with the mean of the last L adjusted prices over 100, where L depends on the bar.

    L has no bound, so no window can hold it: the sum over the last L bars is the
    difference of two running sums, the older one fetched by an equi-join on the ordinal.
    """
    length = F.when(c("vpci").isNull(), 1.0).when(c("vpc") < 0, F.floor(F.abs(c("vpci") - 3) + 0.5)).otherwise(
        F.floor(c("vpci") + 3.5))
    unit = F.when((c("vpc") > -1) & (c("vpc") < 0), -1.0).when((c("vpc") >= 0) & (c("vpc") < 1), 1.0).otherwise(c("vpc"))
    f = f.add(_L=length.cast("long"))
    adjusted = F.when((unit != 0) & (c("vpr") != 0), c(price) / F.nullif(unit * c("vpr"), F.lit(0.0))).when(
        (unit == 0) | (c("vpr") == 0), 0.0)
    f = f.add(_adj=adjusted)
    f = running(f, f.back, _P=("sum", F.coalesce("_adj", F.lit(0.0))), _N=("sum", c("_adj").isNull().cast("long")))
    rows = f.core()
    older = rows.select("symbol", c("idx").alias("_j"), c("_P").alias("_P0"), c("_N").alias("_N0"))
    rows = rows.withColumn("_j", c("idx") - F.greatest(c("_L"), F.lit(0))).join(older, ["symbol", "_j"], "left")
    total = F.when(c("_N") == F.coalesce(c("_N0"), F.lit(0)), c("_P") - F.coalesce(c("_P0"), F.lit(0.0)))
    mean_v = F.when(c("_L") <= 0, c(price)).otherwise(total / F.nullif(c("_L"), F.lit(0)) / 100.0)
    return rows.withColumn("_priceV", mean_v)


def avs_line(numbered: DataFrame, out: str, price: str, fast: int, slow: int, stand_div: float = 1.0, sign: int = 1,
             max_deviation: float | None = None, fill: bool = False) -> DataFrame:
    """``sign=1``: support under the lows; ``sign=-1``: resistance over the highs."""
    have = numbered.columns
    f = avs_base(Frame.of_numbered(numbered, back=max(fast, slow)), fast, slow, stand_div)
    rows = settled(_segment_mean(f, price))
    dev = c("dev") if max_deviation is None else F.greatest(F.lit(-max_deviation), F.least(F.lit(max_deviation), c("dev")))
    rows = rows.withColumn("_adjusted", c(price) - sign * c("_priceV") + sign * dev)
    f = Frame.of_numbered(rows.select(*have, "_adjusted"), back=slow)
    if fill:
        f = running(f, 0, _adjusted=("last", c("_adjusted")))
    return f.add(**{out: mean(f, "_adjusted", slow)}).core(*have, out)


def avsl(numbered: DataFrame, fast: int = 5, slow: int = 20, stand_div: float = 1.0,
         max_deviation: float | None = None) -> DataFrame:
    return avs_line(numbered, "avsl", "low", fast, slow, stand_div, 1, max_deviation)


def avsr(numbered: DataFrame, fast: int = 5, slow: int = 20, stand_div: float = 1.0,
         max_deviation: float | None = None) -> DataFrame:
    return avs_line(numbered, "avsr", "high", fast, slow, stand_div, -1, max_deviation)


def fast_line(numbered: DataFrame, fast: int = 70, slow: int = 345, stand_div: float = 2.0) -> DataFrame:
    """The support line whose gaps are filled forward before the last average."""
    return avs_line(numbered, "line", "low", fast, slow, stand_div, 1, fill=True)


def channel_state(f: Frame) -> Frame:
    """Where the close sits against the two lines, and fresh breakouts."""
    inside = (c("close") >= c("avsl")) & (c("close") <= c("avsr"))
    f = f.add(inside=inside)
    return f.add(
        break_up=f.lag(c("inside")) & (c("close") > c("avsr")),
        break_down=f.lag(c("inside")) & (c("close") < c("avsl")),
    )


def ott(f: Frame, n: int = 2, percent: float = 1.4, mode: str = "VAR") -> Frame:
    """Optimised trend tracker: cumulative stops and a two-state direction."""
    mode, first = mode.upper(), n - 1
    if mode == "VAR":
        f = f.add(_d=F.coalesce(c("close") - f.lag(c("close")), F.lit(0.0)))
        f = f.add(_u=F.greatest("_d", F.lit(0.0)), _w=F.greatest(-c("_d"), F.lit(0.0)))
        f = f.add(_su=rolling_sum(f, "_u", 9), _sd=rolling_sum(f, "_w", 9))
        k = 2 / (n + 1) * F.abs(ratio(c("_su") - c("_sd"), c("_su") + c("_sd"), F.lit(0.0)))
        f = f.add(_k=F.coalesce(k, F.lit(0.0)))
        b = F.when(c("idx") == 0, c("close")).otherwise(c("_k") * c("close"))
        f, first, warm = recur_varying(f, "ma", 1 - c("_k"), b, 0, 1 - 2 / (n + 1), 10), 0, 10
    elif mode == "WWMA":
        f, first, warm = recur(f, [Chain(("ma",), c("close") * F.when(c("idx") == 0, 1.0).otherwise(1 / n), 1 - 1 / n, 1.0, 0, 0)]), 0, 0
    elif mode == "EMA":
        f, warm = ema(f, "ma", "close", n), 0
    elif mode == "WMA":
        f, warm = wma(f, "ma", "close", n), n
    elif mode == "TMA":
        f, warm = sma(sma(f, "_m", "close", -(-n // 2)), "ma", "_m", n // 2 + 1), n + 1
    elif mode == "TSF":
        f, warm = linreg(f, "ma", "close", n, mode="tsf"), n
    elif mode == "ZLEMA":
        f = f.add(_zl=2 * c("close") - f.lag(c("close"), n // 2))
        f, warm = ema(f, "ma", "_zl", n, first=n // 2, warm=n // 2), n // 2
    else:
        f, warm = sma(f, "ma", "close", n), n
    f = f.settle()
    band = c("ma") * percent / 100.0
    f = running(f, warm, long_stop=("max", c("ma") - band), short_stop=("min", c("ma") + band))
    f = two_state(f, "dir", c("ma") > f.lag(c("short_stop")), c("ma") < f.lag(c("long_stop")), 1, warm + 1)
    stop = F.when(c("dir") == 1, c("long_stop")).otherwise(c("short_stop"))
    return f.add(ott=F.when(c("ma") > stop, stop * (200 + percent) / 200).otherwise(stop * (200 - percent) / 200))


def scrsi(f: Frame, cycle: int = 20, vibration: int = 10) -> Frame:
    """Cyclic-smoothed RSI; the bands come from :func:`scrsi_bands`."""
    half = cycle // 2
    f = f.add(_d=F.coalesce(c("close") - f.lag(c("close")), F.lit(0.0)))
    f = f.add(_u=F.greatest("_d", F.lit(0.0)), _w=F.greatest(-c("_d"), F.lit(0.0)))
    f = f.add(_mu=mean(f, "_u", half), _md=mean(f, "_w", half))
    up, dn = c("_mu"), c("_md")
    raw = F.when((up == 0) & (dn == 0), 50.0).when(up == 0, 0.0).when(dn == 0, 100.0).otherwise(
        100.0 - 100.0 / (1 + ratio(up, dn)))
    f = f.add(rsi=(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) - 50) * 2)
    torque, lag = 2 / (vibration + 1), (vibration - 1) // 2
    # the smoother starts at zero on the first bar and stays missing once a missing input enters it
    f = f.add(_in=torque * (2 * c("rsi") - f.lag(c("rsi"), lag)))
    f = recur(f, [Chain(("crsi",), c("_in"), 1 - torque, 1.0, 0, lag)], half + lag)
    return f.add(crsi=F.when(c("idx") < lag, 0.0).otherwise(c("crsi")))


def scrsi_bands(rows: DataFrame, cycle: int = 20, leveling: float = 10.0) -> DataFrame:
    """Percentile bands of the first ``2*cycle`` smoothed values of each symbol, wherever they start.

    Counts per chunk tell which chunks hold these values; only the rows of such chunks are numbered.
    """
    some = rows.filter(c("crsi").isNotNull()).withColumn("_chunk", F.floor(c("idx") / SIZE))
    counts = some.groupBy("symbol", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("symbol", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).filter(c("_before") < 2 * cycle)
    rank = F.row_number().over(Window.partitionBy("symbol", "_chunk").orderBy("idx"))
    head = some.join(first, ["symbol", "_chunk"]).withColumn("_r", rank + c("_before")).filter(c("_r") <= 2 * cycle)
    enough = F.count(F.lit(1)) >= 2 * cycle
    bands = head.groupBy("symbol").agg(
        F.when(enough, F.percentile("crsi", leveling / 100)).otherwise(-100.0).alias("lower"),
        F.when(enough, F.percentile("crsi", 1 - leveling / 100)).otherwise(100.0).alias("upper"),
    )
    return bands
