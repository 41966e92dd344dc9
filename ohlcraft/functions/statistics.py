"""Rolling statistics on frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import KEY, Frame
from .rolling import c, mean, ratio, std, values, var


def entropy(f: Frame, n: int = 10, base: float = 2.0) -> Frame:
    """Shannon entropy of the value frequencies in the window."""
    f = f.add(_a=values(f, "close", n))

    def term(v):
        p = F.size(F.filter("_a", lambda u: u == v)) / n
        return p * F.log(p)

    total = F.aggregate(F.transform(F.array_distinct("_a"), term), F.lit(0.0), lambda s, t: s + t)
    return f.add(entropy=F.when(c("_a").isNotNull(), -total / math.log(base)))


def kurtosis(f: Frame, n: int = 30) -> Frame:
    """Bias-adjusted excess kurtosis."""
    g2 = f.full(F.kurtosis("close"), c("close"), n)
    return f.add(kurtosis=(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def skew(f: Frame, n: int = 30) -> Frame:
    g1 = f.full(F.skewness("close"), c("close"), n)
    return f.add(skew=g1 * math.sqrt(n * (n - 1)) / (n - 2))


def mad(f: Frame, n: int = 30) -> Frame:
    f = f.add(_a=values(f, "close", n), _m=mean(f, "close", n))
    return f.add(mad=F.aggregate("_a", F.lit(0.0), lambda s, v: s + F.abs(v - c("_m"))) / n)


def median(f: Frame, n: int = 30) -> Frame:
    return f.add(median=f.full(F.percentile("close", 0.5), c("close"), n))


def quantile(f: Frame, n: int = 30, q: float = 0.5) -> Frame:
    """Nearest rank ``round(q*(n-1))``, half to even."""
    return f.add(quantile=F.element_at(F.array_sort(values(f, "close", n)), round(q * (n - 1)) + 1))


def stdev(f: Frame, n: int = 30, ddof: int = 1, columns: tuple[str, ...] = ("close",)) -> Frame:
    return f.add(**{f"{x}_stdev": std(f, x, n, ddof) for x in columns})


def variance(f: Frame, n: int = 30, ddof: int = 1) -> Frame:
    return f.add(variance=var(f, "close", n, ddof))


def zscore(f: Frame, n: int = 30, k: float = 1.0, ddof: int = 1, x: str = "close", out: str = "zscore") -> Frame:
    return f.add(**{out: ratio(c(x) - mean(f, x, n), k * std(f, x, n, ddof))})


def regression_band(numbered: DataFrame, n: int | None = None, stds=(1.0, 2.0, 3.0), ddof: int = 1) -> DataFrame:
    """Line fitted to the last ``n`` bars of each symbol (all bars when None) with bands.

    The fit is one aggregation per symbol; only its few numbers are joined back.
    """
    last = numbered.groupBy(KEY).agg(F.max("idx").alias("_last"))
    rows = numbered.join(last, KEY)
    if n is not None:
        rows = rows.filter(c("idx") > c("_last") - n)
    x = c("idx").cast("double")
    spread = F.stddev_samp("close") if ddof == 1 else F.stddev_pop("close")
    fit = rows.groupBy(KEY).agg(
        F.regr_slope("close", x).alias("_b"), F.regr_intercept("close", x).alias("_a"), spread.alias("_s"),
    )
    line = c("_a") + c("_b") * x
    out = rows.join(fit, KEY).withColumn("lr", line)
    for m in stds:
        out = out.withColumn(f"l_{m:g}", c("lr") - m * c("_s")).withColumn(f"u_{m:g}", c("lr") + m * c("_s"))
    return out.drop("_a", "_b", "_s", "_last")
