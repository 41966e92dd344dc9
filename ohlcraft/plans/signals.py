"""Entry conditions as columns: history, monotone runs, crosses, rule records."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import c, mean, ratio, rolling_max, rolling_min, std
from ..functions.volatility import atr
from ..operators.frames import Frame
from ..operators.running import running


def true(cond: Column) -> Column:
    """A condition whose missing operands mean no signal."""
    return F.coalesce(cond, F.lit(False))


def truthy(x: Column) -> Column:
    return true(x != 0)


def number(cond: Column) -> Column:
    return true(cond).cast("double")


def chain(first: Column, *links: tuple[str, Column]) -> Column:
    """``chain(a, ("<", b), ("<=", d))`` is ``a < b and b <= d``."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
           "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    out, left = F.lit(True), first
    for op, right in links:
        out, left = out & true(ops[op](left, right)), right
    return out


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for a zero divisor."""
    return a - F.floor(a / F.nullif(b, F.lit(0.0))) * b


def divide(a: Column, b: Column) -> Column:
    return ratio(a, b)


def history(f: Frame, x: str, n: int) -> Column:
    return f.lag(c(x), n)


def window_values(f: Frame, x: str, n: int) -> Column:
    """The last n values, oldest first."""
    return F.collect_list(x).over(f.rows(n))


def _monotone(f: Frame, x: str, n: int, up: bool) -> tuple[Frame, Column]:
    if n < 2:
        return f, c(x).isNotNull()
    step = f.lag(c(x))
    name = f"_{'up' if up else 'dn'}_{x}"
    f = f.add(**{name: F.when((c(x) > step) if up else (c(x) < step), 1).otherwise(0)})
    return f, F.sum(name).over(f.rows(n - 1)) == n - 1


def rising(f: Frame, x: str, n: int) -> tuple[Frame, Column]:
    """Strictly rising over the last n values."""
    return _monotone(f, x, n, True)


def falling(f: Frame, x: str, n: int) -> tuple[Frame, Column]:
    return _monotone(f, x, n, False)


# averages of equal bars differ in their last bits only, by the order of summing
SAME = 1e-12


def side_of(x: Column, line: Column) -> Column:
    """1 above the line, -1 below, 0 on it but for rounding; NULL if one is missing."""
    gap = F.abs(x - line)
    on = (x == line) | ((gap < math.inf) & (gap < SAME * (F.abs(x) + F.abs(line))))
    return F.when(x.isNotNull() & line.isNotNull(), F.when(on, 0).when(x > line, 1).otherwise(-1))


def crosses(f: Frame, x: str, line: str, strict: bool = True) -> Frame:
    """``cross_up`` / ``cross_down``; with ``strict`` the previous bar must lie strictly on the other side."""
    f = f.add(_side=side_of(c(x), c(line)))
    now, was = c("_side"), f.lag(c("_side"))
    below = was < 0 if strict else was <= 0
    above = was > 0 if strict else was >= 0
    return replace(f, df=f.add(cross_up=true((now > 0) & below), cross_down=true((now < 0) & above)).df.drop("_side"))


def donchian(f: Frame, n: int = 20) -> Frame:
    """Breakouts of the prior n-bar range."""
    hi, lo = f.full(F.max("high"), c("high"), n, 1), f.full(F.min("low"), c("low"), n, 1)
    f = f.add(don_hi=hi, don_lo=lo)
    return f.add(don_up=true(c("close") > c("don_hi")), don_down=true(c("close") < c("don_lo")))


def z_entries(f: Frame, n: int = 20, enter: float = 2.0) -> Frame:
    z = ratio(c("close") - mean(f, "close", n), std(f, "close", n, 0))
    f = f.add(z=z)
    was = f.lag(c("z"))
    return f.add(z_long=true((c("z") <= -enter) & (was > -enter)), z_short=true((c("z") >= enter) & (was < enter)))


def taker_flow(f: Frame, n: int = 50) -> Frame:
    """Rolling z-score of the buy share against the sign of the return."""
    f = f.add(_sh=ratio(c("buy_volume"), c("volume")))
    f = f.add(flow_z=ratio(c("_sh") - mean(f, "_sh", n), std(f, "_sh", n, 0)), _ret=c("close") - f.lag(c("close")))
    return f.add(diverge=F.when((c("flow_z") > 1) & (c("_ret") < 0), 1).when((c("flow_z") < -1) & (c("_ret") > 0), -1).otherwise(0))


@dataclass(frozen=True)
class Rule:
    """A trading rule: conditions and the outcome parameters, all plain values and columns."""

    name: str
    long: Column
    short: Column
    stop_line: Column | None = None
    k_atr: float = 2.0
    target_r: float = 5.0
    horizon: int = 500
    fee: float = 0.0005
    warmup: int = 400
    gates: dict[str, float] = field(default_factory=dict)


def entries(rows: DataFrame, rule: Rule) -> DataFrame:
    """Rows where the rule fires after its warm-up, with side and initial risk.

    Risk is the wider of ``k_atr`` ATRs and the distance to the stop line.
    """
    risk = rule.k_atr * c("atr") if rule.stop_line is None else F.greatest(
        F.abs(c("close") - rule.stop_line), F.when(rule.stop_line.isNotNull(), rule.k_atr * c("atr")))
    out = rows.withColumns({"_l": true(rule.long), "_s": true(rule.short), "risk": risk})
    out = out.filter((c("_l") | c("_s")) & (c("idx") >= rule.warmup) & (c("risk") > 0))
    return out.withColumn("is_long", c("_l")).drop("_l", "_s")


def cross_rule(fast_line: str = "line", **kw) -> Rule:
    """Close crossing a support line, stop at that line."""
    return Rule("line_cross", c("cross_up"), c("cross_down"), c(fast_line), **kw)


def validate_params(catalog: dict, name: str, **params) -> dict:
    """Fill defaults and check a call against the catalog before any column is built."""
    if name not in catalog:
        raise KeyError(f"unknown indicator {name!r}")
    spec = catalog[name]
    unknown = set(params) - set(spec.params)
    if unknown:
        raise ValueError(f"{name}: unknown parameters {sorted(unknown)}")
    out = {}
    for key, (default, low, high) in spec.params.items():
        value = params.get(key, default)
        if low is not None and value < low or high is not None and value > high:
            raise ValueError(f"{name}: {key}={value} outside [{low}, {high}]")
        out[key] = value
    return out


def nan_policy(f: Frame, x: str, policy: str, out: str) -> Frame:
    """``ignore``, ``raise``, ``ffill``, ``bfill`` or ``both`` for missing values; infinities count as missing."""
    clean = F.when(~(F.isnan(x) | (F.abs(c(x)) == float("inf"))), c(x))
    f = f.add(_cl=clean)
    if policy == "ignore":
        return f.add(**{out: c("_cl")})
    if policy == "raise":
        return f.add(**{out: F.when(c("_cl").isNull(), F.raise_error(F.lit(f"missing value in {x}")).cast("double")).otherwise(c("_cl"))})
    if policy in ("ffill", "both"):
        f = running(f, 0, _ff=("last", c("_cl")))
    else:
        f = f.add(_ff=c("_cl"))
    if policy in ("bfill", "both"):
        f = backfill(f, "_ff", "_ff")
    return f.add(**{out: c("_ff")})


def backfill(f: Frame, x: str, out: str) -> Frame:
    """Next present value, also when it lies chunks ahead."""
    from dataclasses import replace as swap

    from pyspark.sql import Window

    here = f.w.rowsBetween(0, Window.unboundedFollowing)
    own = f.df.filter(f.is_core).groupBy(f.key, "chunk").agg(F.min_by(x, F.when(c(x).isNotNull(), c("idx"))).alias("_n"))
    after = Window.partitionBy(f.key).orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    nxt = own.select(f.key, "chunk", F.first("_n", ignorenulls=True).over(after).alias("_n"))
    f = f.add(_b=F.first(x, ignorenulls=True).over(here))
    df = f.df.join(nxt, [f.key, "chunk"], "left").withColumn(out, F.coalesce("_b", "_n")).drop("_b", "_n")
    return swap(f, df=df)


def shift_fill(f: Frame, x: str, k: int, fill: float | None, out: str) -> Frame:
    moved = f.lag(c(x), k) if k >= 0 else f.lead(c(x), -k)
    return f.add(**{out: moved if fill is None else F.coalesce(moved, F.lit(fill))})
