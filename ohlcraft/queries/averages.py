"""Moving averages over hourly bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import averages as A
from ..functions import volatility as V
from ..functions import weights as W
from ..operators.fold import fold
from ..operators import kernels as K
from ..sources import tables as T
from .base import ORD, Sql, avg, dot_sql, framed, full, indicator, lag, mn, mx, register, rounded, sm, sr, win


def _simple(name, fn, n, sql, **kw):
    indicator(name, 4 * n, lambda f: fn(f, "y", "close", n, **kw), ["y"], sql.out("y"))


_simple("sma", A.sma, 10, Sql().add(y=avg("c", 10)))
_simple("ema", A.ema, 10, Sql().ema("y", "c", 10))
_simple("rma", A.rma, 10, Sql().rma("y", "c", 10))
_simple("smma", A.smma, 7, Sql().rma("y", "c", 7))
_simple("dema", A.dema, 10, Sql().ema("e1", "c", 10).ema("e2", "e1", 10, 9).add(y="2 * e1 - e2"))
_simple("tema", A.tema, 10, Sql().ema("e1", "c", 10).ema("e2", "e1", 10, 9).ema("e3", "e2", 10, 18).add(y="3 * (e1 - e2) + e3"))


def _t3_sql(n: int, a: float) -> Sql:
    s = Sql().ema("e1", "c", n)
    for k in range(2, 7):
        s = s.ema(f"e{k}", f"e{k - 1}", n, (k - 1) * (n - 1))
    return s.add(y=f"{-a**3} * e6 + {3 * a**2 + 3 * a**3} * e5 + {-6 * a**2 - 3 * a - 3 * a**3} * e4 "
                   f"+ {1 + 3 * a + 3 * a**2 + a**3} * e3")


_simple("t3", A.t3, 10, _t3_sql(10, 0.7))
_simple("trima", A.trima, 10, Sql().add(m=avg("c", 5)).add(y=avg("m", 6)))
indicator("trima_odd", 40, lambda f: A.trima(f, "y", "close", 11), ["y"], Sql().add(m=avg("c", 6)).add(y=avg("m", 6)).out("y"))
for _name, _fn, _w, _n in (("wma", A.wma, W.linear, 10), ("fwma", A.fwma, W.fibonacci, 10), ("pwma", A.pwma, W.pascal, 5),
                           ("sinwma", A.sinwma, W.sine, 14), ("swma", A.swma, W.triangle, 10)):
    _simple(_name, _fn, _n, Sql().add(y=dot_sql("c", _w(_n))))
indicator("wma_desc", 20, lambda f: A.wma(f, "y", "close", 10, asc=False), ["y"],
          Sql().add(y=dot_sql("c", W.linear(10, False))).out("y"))
_simple("alma", A.alma, 9, Sql().add(y=dot_sql("c", W.gauss(9, 6.0, 0.85))))
_simple("hma", A.hma, 10, Sql().add(m1=dot_sql("c", W.linear(5)), m2=dot_sql("c", W.linear(10))).add(d="2 * m1 - m2")
        .add(y=dot_sql("d", W.linear(3))))
indicator("hma_ema", 40, lambda f: A.hma(f, "y", "close", 10, mode="ema"), ["y"],
          Sql().ema("m1", "c", 5).ema("m2", "c", 10).add(d="2 * m1 - m2").ema("y", "d", 3, 9).out("y"))


def _linreg_sql(n: int, mode: str) -> str:
    slope = full("regr_slope(c, idx)", "c", n)
    icpt = full("regr_intercept(c, idx)", "c", n)
    s = Sql().add(sl=slope, ic0=icpt)
    s = s.add(ic=f"ic0 + sl * (idx - {n})")
    if mode == "r":
        s = s.add(rr=full("corr(c, idx)", "c", n))
    value = {"line": f"ic + sl * {n}", "tsf": f"ic + sl * {n + 1}", "slope": "sl", "intercept": "ic",
             "angle": "degrees(atan(sl))", "r": "CASE WHEN isnan(rr) THEN 0 ELSE rr END"}[mode]
    return s.add(y=value).out("y")


for _mode in ("line", "tsf", "slope", "intercept", "angle", "r"):
    indicator(f"linreg_{_mode}" if _mode != "line" else "linreg", 40,
              lambda f, m=_mode: A.linreg(f, "y", "close", 14, mode=m, degrees=True), ["y"], _linreg_sql(14, _mode))
_simple("midpoint", A.midpoint, 2, Sql().add(y=f"({mx('c', 2)} + {mn('c', 2)}) / 2"))
indicator("midprice", 4, lambda f: A.midprice(f, "y", 2), ["y"], Sql().add(y=f"({mx('h', 2)} + {mn('l', 2)}) / 2").out("y"))
for _name, _fn, _e in (("hl2", A.hl2, "(h + l) / 2"), ("hlc3", A.hlc3, "(h + l + c) / 3"),
                       ("ohlc4", A.ohlc4, "(o + h + l + c) / 4"), ("wcp", A.wcp, "(h + l + 2 * c) / 4")):
    indicator(_name, 0, lambda f, g=_fn: f.add(y=g()), ["y"], Sql().add(y=_e).out("y"))

_KAMA = (Sql().add(d1=f"coalesce(abs(c - {lag('c')}), 0)", dn=f"abs(c - {lag('c', 10)})", seed=avg("c", 10))
         .add(path=f"sum(d1) OVER {win(10)}")
         .add(sc=f"pow((CASE WHEN path = 0 THEN 0 ELSE dn / path END) * ({2 / 3} - {2 / 31}) + {2 / 31}, 2)")
         .loop("y", "n.seed", "n.sc * n.c + (1 - n.sc) * p.y", 9))
_simple("kama", A.kama, 10, _KAMA)
_VIDYA = (Sql().add(d=f"c - {lag('c')}").add(u="greatest(d, 0)", w="greatest(-d, 0)")
          .add(su=sm("u", 14), sw=sm("w", 14))
          .add(k=f"{2 / 15} * abs(CASE WHEN su + sw = 0 THEN 0 ELSE (su - sw) / (su + sw) END)")
          .loop("y", "n.c", "n.k * n.c + (1 - n.k) * p.y", 14))
_simple("vidya", A.vidya, 14, _VIDYA)
_simple("zlma", A.zlma, 10, Sql().add(z0=f"2 * c - {lag('c', 4)}")
        .add(z=f"CASE WHEN idx < 4 THEN first_value(z0) OVER (PARTITION BY symbol ORDER BY z0 IS NULL, idx) ELSE z0 END")
        .ema("y", "z", 10))
indicator("alligator", 40, lambda f: A.rma(A.rma(A.rma(f, "jaw", "close", 13), "teeth", "close", 8), "lips", "close", 5),
          ["jaw", "teeth", "lips"], Sql().rma("jaw", "c", 13).rma("teeth", "c", 8).rma("lips", "c", 5).out("jaw", "teeth", "lips"))
for _mode in ("sma", "wma", "trima", "unknown"):
    _sql = {"sma": Sql().add(y=avg("c", 8)), "wma": Sql().add(y=dot_sql("c", W.linear(8))),
            "trima": Sql().add(m=avg("c", 4)).add(y=avg("m", 5)), "unknown": Sql().ema("y", "c", 8)}[_mode]
    indicator(f"ma_mode_{_mode}", 20, lambda f, m=_mode: A.ma(f, m, "y", "close", 8), ["y"], _sql.out("y"))


def _folded(name, kernel, sql, bars=T.bars):
    def run(spark, sf_dir):
        rows = bars(spark, sf_dir).withColumn("x", F.col("close"))
        return rounded(fold(rows, kernel, ["x"], {"y": "double"}), ["symbol", "idx"], ["y"])

    register(name, run, sql)


def _smooth_bars(spark, sf_dir):
    """The fourth power in this average needs a series without jumps: a long mean of the closes."""
    f = framed(spark, sf_dir, 200)
    f = f.add(close=F.avg("close").over(f.rows(200)))
    return f.core("symbol", (F.col("idx") - 100).alias("idx"), "close").filter("idx >= 0")


_folded("mcgd", K.mcginley(10), Sql().add(m=f"avg(c) OVER {win(200)}").step(
    "SELECT symbol, idx - 100 AS idx, m AS c FROM b1 WHERE idx >= 100").loop(
    "y", "n.c", "CASE WHEN p.y = 0 THEN n.c WHEN n.c = 0 THEN p.y ELSE p.y + (n.c - p.y) / (10 * pow(n.c / p.y, 4)) END").out("y"), _smooth_bars)


def _ssf_sql() -> str:
    w = 3.14159 * 1.414 / 20
    r = math.exp(-w)
    b = 2 * r * math.cos(w)
    gain = (r * r - b + 1) / 2
    step = f"{{'y': CASE WHEN n.idx < 2 THEN n.c ELSE {gain} * (n.c + n.c1) + {b} * p.s.y + {-r * r} * p.s.y1 END, 'y1': p.s.y}}"
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, {lag('c')} AS c1 FROM ({Sql().parts[0][1]})),
q AS (SELECT symbol, idx, {{'y': c, 'y1': 0.0::DOUBLE}} AS s FROM b WHERE idx = 0
 UNION ALL SELECT n.symbol, n.idx, {step} FROM q p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1)
SELECT symbol, idx, {sr('s.y')} AS y FROM q"""


def _ssf3_sql() -> str:
    r = math.exp(-3.14159 / 20)
    b = 2 * r * math.cos(3.14159 * 1.732 / 20)
    q = r * r
    d2, d3, d4 = b + q, -q * (1 + b), q * q
    step = (f"{{'y': CASE WHEN n.idx < 3 THEN n.c ELSE {1 - d2 - d3 - d4} * n.c + {d2} * p.s.y + {d3} * p.s.y1 + {d4} * p.s.y2 END, "
            "'y1': p.s.y, 'y2': p.s.y1}")
    return f"""WITH RECURSIVE b AS MATERIALIZED ({Sql().parts[0][1]}),
q AS (SELECT symbol, idx, {{'y': c, 'y1': 0.0::DOUBLE, 'y2': 0.0::DOUBLE}} AS s FROM b WHERE idx = 0
 UNION ALL SELECT n.symbol, n.idx, {step} FROM q p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1)
SELECT symbol, idx, {sr('s.y')} AS y FROM q"""


_folded("ssf", K.super_smoother(20), _ssf_sql())
_folded("ssf3", K.super_smoother3(20), _ssf3_sql())
_folded("hwma", K.holt_winters(0.2, 0.1, 0.1), f"""WITH RECURSIVE b AS MATERIALIZED ({Sql().parts[0][1]}),
st AS (SELECT symbol, 0::BIGINT AS idx, 0.2 * c + 0.8 * c AS f, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a FROM b WHERE idx = 0
 UNION ALL
 SELECT symbol, idx, f, v, 0.9 * a + 0.1 * (v - v0) FROM (
  SELECT symbol, idx, f, 0.9 * (v0 + a) + 0.1 * (f - f0) AS v, a, v0 FROM (
   SELECT n.symbol, n.idx, 0.8 * (p.f + p.v + 0.5 * p.a) + 0.2 * n.c AS f, p.f AS f0, p.v AS v0, p.a AS a
   FROM st p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1)))
SELECT symbol, idx, {sr('f + v + 0.5 * a')} AS y FROM st""")

indicator("hilo", 50, lambda f: V.hilo(f), ["hilo", "hilo_long", "hilo_short"],
          Sql().add(hm=avg("h", 13), lm=avg("l", 21))
          .add(way=f"CASE WHEN c > {lag('hm')} THEN 1 WHEN c < {lag('lm')} THEN -1 END")
          .add(grp=f"count(way) OVER {ORD}")
          .add(hilo=f"first_value(CASE WHEN way = 1 THEN lm WHEN way = -1 THEN hm END) OVER (PARTITION BY symbol, grp ORDER BY idx)")
          .add(hilo_long="CASE WHEN way IS NULL OR way = 1 THEN hilo END", hilo_short="CASE WHEN way IS NULL OR way = -1 THEN hilo END")
          .out("hilo", "hilo_long", "hilo_short"))
indicator("ichimoku", 90, lambda f: V.ichimoku(f), ["tenkan", "kijun", "span_a", "span_b", "chikou"],
          Sql().add(tenkan=f"({mx('h', 9)} + {mn('l', 9)}) / 2", kijun=f"({mx('h', 26)} + {mn('l', 26)}) / 2",
                    sb=f"({mx('h', 52)} + {mn('l', 52)}) / 2").add(sa="(tenkan + kijun) / 2")
          .add(span_a=lag("sa", 26), span_b=lag("sb", 26), chikou=f"lead(c, 26) OVER {ORD}")
          .out("tenkan", "kijun", "span_a", "span_b", "chikou"), ahead=26)
