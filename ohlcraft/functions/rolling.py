"""Rolling primitives on frames: the value is NULL until the window is full."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators.frames import Frame


def c(name: str) -> Column:
    return F.col(name)


def rolling_max(f: Frame, x: str, n: int) -> Column:
    return f.full(F.max(x), c(x), n)


def rolling_min(f: Frame, x: str, n: int) -> Column:
    return f.full(F.min(x), c(x), n)


def rolling_sum(f: Frame, x: str, n: int) -> Column:
    return f.full(F.sum(x), c(x), n)


def mean(f: Frame, x: str, n: int) -> Column:
    return f.full(F.avg(x), c(x), n)


def std(f: Frame, x: str, n: int, ddof: int = 1) -> Column:
    return f.full(F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x), c(x), n)


def var(f: Frame, x: str, n: int, ddof: int = 1) -> Column:
    return f.full(F.var_samp(x) if ddof == 1 else F.var_pop(x), c(x), n)


def values(f: Frame, x: str, n: int, lag: int = 0) -> Column:
    """The window as an array, oldest first."""
    return f.full(F.collect_list(x), c(x), n, lag)


def expanding_mean(f: Frame, x: str, n: int) -> Column:
    """Mean of what exists for the first bars, then the rolling mean."""
    return F.avg(x).over(f.rows(n))


def dot(f: Frame, x: str, weights: list[float]) -> Column:
    """Weighted window sum; ``weights`` are oldest first."""
    n = len(weights)
    total = F.lit(0.0)
    for k in range(n):
        total = total + f.lag(c(x), k) * F.lit(weights[n - 1 - k])
    return total


def ratio(num: Column, den: Column, zero: Column | None = None) -> Column:
    """``num/den``; ``zero`` (NULL by default) where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(None) if zero is None else F.when(den == 0, zero))


def up_to_here(f: Frame):
    return f.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def percent_rank(f: Frame, x: str, n: int, strict: bool = False, prior: bool = False) -> Column:
    """Share of the trailing window at or below (``strict``: below) the current value."""
    win = f.rows(n, 1) if prior else f.rows(n)
    arr = F.collect_list(x).over(win)
    # `_cur` keeps the current value visible inside the lambda
    hit = F.filter(arr, lambda v: (v < c(x)) if strict else (v <= c(x)))
    return F.when(c(x).isNotNull() & (F.size(arr) > 0), F.size(hit) / F.size(arr))
