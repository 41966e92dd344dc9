"""Candle patterns and alternative charts, each checked against predicates written in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import candles as P
from ..functions import statistics as S
from ..operators import kernels as K
from ..operators.fold import fold
from ..operators.frames import Frame
from ..sources import tables as T
from .base import ORD, Sql, bars_sql, div, full, indicator, lag, avg, register, rounded, sr, win

_COLS = ", ".join(
    f"{x}{k}, abs(c{k} - o{k}) AS b{k}, h{k} - l{k} AS r{k}".replace(f"{x}{k}, ", "") +
    f", greatest(o{k}, c{k}) AS t{k}, least(o{k}, c{k}) AS m{k}, h{k} - greatest(o{k}, c{k}) AS u{k}, least(o{k}, c{k}) - l{k} AS d{k}, "
    f"c{k} > o{k} AS w{k}, c{k} < o{k} AS k{k}"
    for k in range(5) for x in "o")
_LAGS = ", ".join(f"{x} AS {x}0" for x in "ohlc") + ", " + ", ".join(f"lag({x}, {k}) OVER {ORD} AS {x}{k}" for k in range(1, 5) for x in "ohlc")
_AHEAD = "(PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"


def twin(bull: str | None, bear: str | None = None, strict: str = "TRUE") -> str:
    value = "0.0"
    if bear:
        value = f"CASE WHEN ({bear}) AND ({strict}) THEN -1.0 ELSE {value} END"
    if bull:
        value = f"CASE WHEN ({bull}) AND ({strict}) THEN 1.0 ELSE {value} END"
    return f"""WITH b AS ({bars_sql()}), x AS (SELECT symbol, idx, {_LAGS},
 count(l) OVER {_AHEAD} AS n3, min(l) OVER {_AHEAD} AS nl, max(h) OVER {_AHEAD} AS nh, min(c) OVER {_AHEAD} AS ncl, max(c) OVER {_AHEAD} AS nch,
 count(o) OVER {win(5, 1)} AS q, avg(abs(c - o)) OVER {win(5, 1)} AS qb, avg(h - greatest(o, c)) OVER {win(5, 1)} AS qu, avg(least(o, c) - l) OVER {win(5, 1)} AS ql FROM b),
y AS (SELECT *, {_COLS} FROM x) SELECT symbol, idx, ({value})::DOUBLE AS y FROM y"""


def _strict(ks: str, mb: float, ms: float) -> str:
    return " AND ".join(f"b{k} >= {mb} * r{k} AND u{k} + d{k} <= {ms} * r{k}" for k in ks)


TWINS = {
    "2crows": ("w2 AND k1 AND o1 > c2 AND c1 > o2 AND c1 < c2 AND k0 AND o0 > c1 AND c0 < c1",),
    "3blackcrows": ("k2 AND k1 AND k0 AND o1 < o2 AND o1 > c2 AND o0 < o1 AND o0 > c1 AND c2 > c1 AND c1 > c0",),
    "3inside": ("k2 AND w1 AND o1 < o2 AND c1 > c2 AND w0 AND c0 > c1", "w2 AND k1 AND o1 > c2 AND c1 < o2 AND k0 AND c0 < c1"),
    "3linestrike": ("w3 AND w2 AND w1 AND c2 > c3 AND c1 > c2 AND k0 AND o0 > c1 AND c0 < c3", "k3 AND k2 AND k1 AND c2 < c3 AND c1 < c2 AND w0 AND o0 < c1 AND c0 > c3"),
    "3outside": ("k2 AND w1 AND o1 <= c2 AND c1 >= o2 AND w0 AND c0 > c1", "w2 AND k1 AND o1 >= c2 AND c1 <= o2 AND k0 AND c0 < c1"),
    "3starsinsouth": ("k2 AND k1 AND k0 AND l1 < l2 AND l0 < l1 AND c0 > c1",),
    "3whitesoldiers": ("w2 AND w1 AND w0 AND c1 > c2 AND c0 > c1 AND o1 > o2 AND o0 > o1",),
    "abandonedbaby": ("k2 AND b1 <= .1 * r1 AND l1 > h2 AND o0 > h1 AND w0", "w2 AND b1 <= .1 * r1 AND h1 < l2 AND o0 < l1 AND k0"),
    "advanceblock": (None, "w2 AND w1 AND w0 AND c1 > c2 AND c0 > c1 AND o1 > o2 AND o0 > o1 AND b1 < b2 AND b0 < b1"),
    "belthold": ("w0 AND o0 = l0 AND b0 > .5 * r0", "k0 AND o0 = h0 AND b0 > .5 * r0"),
    "breakaway": ("k4 AND k3 AND k2 AND k1 AND o3 < l4 AND w0 AND c0 > c1 AND c0 > c4", "w4 AND w3 AND w2 AND w1 AND o3 > h4 AND k0 AND c0 < c1 AND c0 < c4"),
    "closingmarubozu": ("w0 AND c0 = h0", "k0 AND c0 = l0"),
    "concealbabyswall": ("k3 AND k2 AND k1 AND k0 AND c3 = h3 AND c2 = h2 AND o1 < o2 AND o1 > c2 AND c1 < c2 AND o0 < o1 AND o0 > c1 AND c0 < c1",),
    "counterattack": ("k1 AND w0 AND o0 < l1 AND c0 > c1 AND abs(c0 - c1) <= .25 * (r0 + r1)", "w1 AND k0 AND o0 > h1 AND c0 < c1 AND abs(c0 - c1) <= .25 * (r0 + r1)"),
    "darkcloudcover": (None, "w1 AND k0 AND o0 > h1 AND c0 < c1 AND c0 > o1 AND c0 < (o1 + c1) / 2"),
    "dojistar": ("r1 > 0 AND r0 > 0 AND b0 <= .1 * r0 AND h0 < l1", "r1 > 0 AND r0 > 0 AND b0 <= .1 * r0 AND l0 > h1"),
    "dragonflydoji": ("r0 > 0 AND b0 <= .1 * r0 AND o0 = h0 AND c0 = h0",),
    "gravestonedoji": (None, "r0 > 0 AND b0 <= .1 * r0 AND o0 = l0 AND c0 = l0"),
    "engulfing": ("k1 AND w0 AND o0 <= c1 AND c0 >= o1", "w1 AND k0 AND o0 >= c1 AND c0 <= o1"),
    "eveningdojistar": (None, "w2 AND r1 > 0 AND b1 <= .1 * r1 AND l1 > h2 AND k0 AND c0 <= (o2 + c2) / 2"),
    "eveningstar": (None, "w2 AND r1 > 0 AND b1 <= .3 * r1 AND l1 > h2 AND k0 AND c0 <= (o2 + c2) / 2"),
    "gapsidesidewhite": ("w2 AND w1 AND w0 AND l1 > h2 AND abs(o0 - o1) <= .25 * (r0 + r1) AND abs(c0 - c1) <= .25 * (r0 + r1)",
                         "k2 AND w1 AND w0 AND h1 < l2 AND abs(o0 - o1) <= .25 * (r0 + r1) AND abs(c0 - c1) <= .25 * (r0 + r1)"),
    "hammer": ("b0 > 0 AND t0 - l0 >= 2 * b0 AND u0 <= b0",),
    "hangingman": (None, "b0 > 0 AND t0 - l0 >= 2 * b0 AND u0 <= b0"),
    "harami": ("k1 AND w0 AND o0 >= c1 AND c0 <= o1", "w1 AND k0 AND o0 <= c1 AND c0 >= o1"),
    "haramicross": ("r0 > 0 AND b0 <= .1 * r0 AND k1 AND o0 >= c1 AND c0 <= o1", "r0 > 0 AND b0 <= .1 * r0 AND w1 AND o0 <= c1 AND c0 >= o1"),
    "highwave": ("r0 > 0 AND b0 <= .1 * r0 AND u0 >= .3 * r0 AND t0 - l0 >= .3 * r0",),
    "hikkake": ("n3 = 3 AND h1 < h2 AND l1 > l2 AND l0 < l1 AND h0 <= h1 AND nh > h1", "n3 = 3 AND h1 < h2 AND l1 > l2 AND h0 > h1 AND l0 >= l1 AND nl < l1"),
    "hikkakemod": ("n3 = 3 AND h1 < h2 AND l1 > l2 AND l0 < l1 AND h0 <= h1 AND nch > h1", "n3 = 3 AND h1 < h2 AND l1 > l2 AND h0 > h1 AND l0 >= l1 AND ncl < l1"),
    "homingpigeon": ("k1 AND k0 AND o0 <= o1 AND c0 >= c1",),
    "identical3crows": ("k2 AND k1 AND k0 AND c1 < c2 AND c0 < c1 AND c2 - l2 <= .25 * r2 AND c1 - l1 <= .25 * r1 AND c0 - l0 <= .25 * r0 AND abs(o1 - c2) <= .25 * r1 AND abs(o0 - c1) <= .25 * r0",),
    "inneck": ("k1 AND w0 AND o0 < l1 AND c0 > c1 AND c0 <= o1 AND c0 - c1 <= .25 * r1",),
    "inside": ("h0 < h1 AND l0 > l1",),
    "invertedhammer": ("b0 > 0 AND u0 >= 2 * b0 AND t0 - l0 <= .25 * b0 AND b0 <= .4 * r0",),
    "kicking": ("r1 > 0 AND r0 > 0 AND u1 <= .1 * r1 AND d1 <= .1 * r1 AND u0 <= .1 * r0 AND d0 <= .1 * r0 AND ((w1 AND k0) OR (k1 AND w0)) AND (m0 > t1 OR t0 < m1)",),
    "kickingbylength": ("r1 > 0 AND r0 > 0 AND u1 <= .1 * r1 AND d1 <= .1 * r1 AND u0 <= .1 * r0 AND d0 <= .1 * r0 AND ((w1 AND k0) OR (k1 AND w0)) AND (m0 > t1 OR t0 < m1) AND b0 > b1",),
    "ladderbottom": ("k4 AND k3 AND k2 AND k1 AND c1 - l1 >= 2 * b1 AND w0 AND c0 > o1",),
    "longleggeddoji": ("r0 > 0 AND b0 <= .1 * r0 AND u0 >= .4 * r0 AND t0 - l0 >= .4 * r0",),
    "longline": ("r0 > 0 AND b0 >= .6 * r0 AND u0 <= .2 * r0 AND d0 <= .2 * r0",),
    "marubozu": ("b0 > 0 AND u0 <= .05 * r0 AND d0 <= .05 * r0 AND b0 >= .9 * r0",),
    "matchinglow": ("k1 AND k0 AND abs(l0 - l1) <= 1e-12 AND c0 > c1",),
    "mathold": ("w4 AND b4 >= .6 * r4 AND " + " AND ".join(f"r{k} > 0 AND b{k} <= .4 * r4 AND h{k} <= c4 AND l{k} >= o4" for k in (3, 2, 1)) + " AND w0 AND c0 > c4",),
    "morningdojistar": ("k2 AND b2 >= .6 * r2 AND r1 > 0 AND b1 <= .1 * r1 AND h1 < c2 AND w0 AND c0 > (o2 + c2) / 2",),
    "morningstar": ("k2 AND b2 >= .6 * r2 AND r1 > 0 AND b1 <= .4 * b2 AND h1 < c2 AND w0 AND b0 >= .6 * r0 AND c0 > (o2 + c2) / 2",),
    "onneck": ("k1 AND b1 >= .6 * r1 AND w0 AND o0 < l1 AND abs(c0 - c1) <= .1 * b1",),
    "piercing": ("k1 AND b1 >= .6 * r1 AND w0 AND b0 >= .6 * r0 AND o0 < l1 AND c0 > (o1 + c1) / 2 AND c0 < o1",),
    "rickshawman": ("r0 > 0 AND b0 <= .1 * r0 AND u0 >= .4 * r0 AND d0 >= .4 * r0 AND abs(u0 - d0) <= .2 * r0",),
    "risefall3methods": ("b4 >= .6 * r4 AND r4 > 0 AND r0 > 0 AND b0 >= .6 * r0 AND " + " AND ".join(f"r{k} > 0 AND b{k} <= .4 * b4 AND h{k} <= h4 AND l{k} >= l4" for k in (3, 2, 1))
                         + " AND ((w4 AND k3 AND k2 AND k1 AND w0 AND c0 > c4) OR (k4 AND w3 AND w2 AND w1 AND k0 AND c0 < c4))",),
    "separatinglines": ("abs(o0 - o1) < 1e-12 AND ((k1 AND w0 AND c0 > c1) OR (w1 AND k0 AND c0 < c1))",),
    "shootingstar": ("r0 > 0 AND b0 <= .3 * r0 AND d0 <= .1 * r0 AND u0 >= .6 * r0 AND u0 >= 2 * b0",),
    "shortline": ("q = 5 AND b0 < .3 * qb AND u0 < .3 * qu AND d0 < .3 * ql",),
    "spinningtop": ("r0 > 0 AND b0 >= .1 * r0 AND b0 <= .4 * r0 AND u0 >= .2 * r0 AND d0 >= .2 * r0",),
    "stalledpattern": ("w2 AND b2 >= .6 * r2 AND w1 AND b1 >= .5 * r1 AND c1 > c2 AND w0 AND b0 < b1 AND b0 <= .5 * r0 AND u0 >= .3 * r0 AND d0 <= .3 * r0 AND c0 > c1 AND c0 - c1 <= .5 * b1",),
    "sticksandwich": ("k2 AND b2 >= .4 * r2 AND w1 AND c1 < o2 AND c1 > c2 AND o1 < o2 AND o1 > c2 AND k0 AND b0 >= .4 * r0 AND abs(c0 - c2) <= 1e-12",),
    "takuri": ("r0 > 0 AND b0 <= .2 * r0 AND u0 <= .1 * r0 AND d0 >= .6 * r0 AND d0 >= 3 * b0",),
    "tasukigap": ("o0 > m1 AND o0 < t1 AND ((w2 AND w1 AND l1 > h2 AND k0 AND c0 > h2 AND c0 < l1) OR (k2 AND k1 AND h1 < l2 AND w0 AND c0 > h1 AND c0 < l2))",),
    "thrusting": ("k1 AND b1 >= .6 * r1 AND w0 AND o0 < l1 AND c0 > c1 AND c0 < (o1 + c1) / 2",),
    "tristar": (" AND ".join(f"r{k} > 0 AND b{k} <= .1 * r{k}" for k in (2, 1, 0)) + " AND (l1 > h2 OR h1 < l2) AND (l0 > h1 OR h0 < l1)",),
    "unique3river": ("k2 AND b2 >= .6 * r2 AND k1 AND b1 <= .4 * b2 AND l1 < l2 AND w0 AND b0 <= .6 * r0 AND c0 > c1 AND c0 < o2 AND o0 > l1",),
    "upsidegap2crows": ("w2 AND b2 >= .6 * r2 AND k1 AND b1 >= .4 * r1 AND c1 > c2 AND k0 AND o0 > o1 AND c0 > c2 AND c0 < c1",),
    "xsidegap3methods": ("(w2 AND w1 AND m1 > t2 AND k0 AND c0 > t2 AND c0 < m1) OR (k2 AND k1 AND t1 < m2 AND w0 AND c0 > t1 AND c0 < m2)",),
}
for _name, _text in TWINS.items():
    indicator(f"cdl_{_name}", 6, lambda f, n=_name: P.candle(f, n, "y"), ["y"], twin(*_text), ahead=3)
indicator("cdl_engulfing_strict", 6, lambda f: P.candle(f, "engulfing", "y", strict=True), ["y"], twin(*TWINS["engulfing"], _strict("10", .3, .5)), ahead=3)
indicator("cdl_3outside_strict", 6, lambda f: P.candle(f, "3outside", "y", strict=True, min_body=0.3, max_shadow=0.8), ["y"],
          twin(*TWINS["3outside"], _strict("210", .3, .8)), ahead=3)
indicator("cdl_3whitesoldiers_symmetric", 6, lambda f: P.candle(f, "3whitesoldiers", "y", symmetric=True), ["y"],
          twin(TWINS["3whitesoldiers"][0], "k2 AND k1 AND k0 AND c1 < c2 AND c0 < c1 AND o1 < o2 AND o0 < o1"), ahead=3)
indicator("cdl_hammer_symmetric", 6, lambda f: P.candle(f, "hammer", "y", symmetric=True), ["y"],
          twin(TWINS["hammer"][0] + " AND c0 >= o0", TWINS["hammer"][0] + " AND c0 < o0"), ahead=3)
indicator("cdl_doji", 12, lambda f: P.doji(f), ["doji"], Sql().add(rg="h - l").add(m=avg("rg", 10)).add(
    doji="CASE WHEN abs(c - o) < 0.1 * m THEN 100.0 ELSE 0.0 END").out("doji"))
indicator("cdl_doji_naive", 1, lambda f: P.doji(f, naive=True), ["doji"], Sql().add(
    doji="CASE WHEN abs(c - o) < 0.1 * (h - l) THEN 100.0 ELSE 0.0 END").out("doji"))


def _z(f):
    for x in ("open", "high", "low", "close"):
        f = S.zscore(f, 30, x=x, out=f"{x}_z")
    return f


_Z = [f"{x}_z" for x in ("open", "high", "low", "close")]
indicator("cdl_z", 30, _z, _Z, Sql().add(**{z: div(f"{z[0]} - {avg(z[0], 30)}", full(f"stddev_samp({z[0]})", z[0], 30)) for z in _Z}).out(*_Z))


def _z_full(spark, sf_dir):
    bars = T.bars(spark, sf_dir)
    stats = bars.groupBy("symbol").agg(*[g(x).alias(f"_{n}{x}") for x in ("open", "high", "low", "close") for n, g in (("m", F.avg), ("s", F.stddev_samp))])
    out = bars.join(stats, "symbol")
    for x in ("open", "high", "low", "close"):
        out = out.withColumn(f"{x}_z", F.when(F.col(f"_s{x}") == 0, 0.0).otherwise((F.col(x) - F.col(f"_m{x}")) / F.nullif(F.col(f"_s{x}"), F.lit(0.0))))
    return rounded(out, ["symbol", "idx"], _Z)


register("cdl_z_full", _z_full, Sql().add(**{z: div(f"{z[0]} - avg({z[0]}) OVER (PARTITION BY symbol)", f"stddev_samp({z[0]}) OVER (PARTITION BY symbol)") for z in _Z}).out(*_Z))

_ALL = sorted(TWINS)


def _count_all(spark, sf_dir):
    f = P.all_candles(Frame.of_numbered(T.bars(spark, sf_dir), 6, 3))
    return f.core().groupBy("symbol").agg(*[F.sum(F.abs(f"cdl_{n}")).cast("long").alias(f"n_{n}") for n in _ALL])




def _value(n: str) -> str:
    text = twin(*TWINS[n])
    start = text.index("SELECT symbol, idx, (", text.rindex("FROM x) SELECT")) + len("SELECT symbol, idx, ")
    return text[start:text.rindex("::DOUBLE AS y")]


register("cdl_all_counts", _count_all, twin("TRUE").split(" SELECT symbol, idx, (CASE")[0] + " SELECT symbol, "
         + ", ".join(f"sum(abs({_value(n)}))::BIGINT AS n_{n}" for n in _ALL) + " FROM y GROUP BY symbol")


def _chart(name, kernel, sql, price="close"):
    def run(spark, sf_dir):
        bars = T.bars(spark, sf_dir).withColumn("x", F.expr(price).cast("double"))
        first = bars.filter(F.col("idx") == 0).select("symbol", F.col("x").alias("p0"))
        rows = bars.join(first, "symbol")
        return fold(rows, kernel, ["x", "p0"], {"way": "long"})

    register(name, run, sql)


_chart("kagi", K.kagi(25.0), f"""WITH RECURSIVE b AS MATERIALIZED ({bars_sql()}),
s AS (SELECT symbol, idx, 0 AS way, c AS mark FROM b WHERE idx = 0 UNION ALL
 SELECT n.symbol, n.idx,
  CASE WHEN p.way = 0 THEN CASE WHEN n.c >= p.mark + 25 THEN 1 WHEN n.c <= p.mark - 25 THEN -1 ELSE 0 END
       WHEN p.way = 1 AND n.c <= p.mark - 25 THEN -1 WHEN p.way = -1 AND n.c >= p.mark + 25 THEN 1 ELSE p.way END,
  CASE WHEN p.way = 0 THEN CASE WHEN abs(n.c - p.mark) >= 25 THEN n.c ELSE p.mark END
       WHEN p.way = 1 THEN CASE WHEN n.c > p.mark OR n.c <= p.mark - 25 THEN n.c ELSE p.mark END
       ELSE CASE WHEN n.c < p.mark OR n.c >= p.mark + 25 THEN n.c ELSE p.mark END END
 FROM s p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1)
SELECT symbol, idx, way::BIGINT AS way FROM s""")
_chart("renko", K.renko(8.0), f"""WITH RECURSIVE b AS MATERIALIZED (SELECT symbol, idx, floor(c) AS c FROM ({bars_sql()})),
s AS (SELECT symbol, idx, 0 AS way, c AS p0, 0::BIGINT AS k FROM b WHERE idx = 0 UNION ALL
 SELECT symbol, idx, CASE WHEN k2 > k THEN 1 WHEN k2 < k THEN -1 ELSE 0 END, p0, k2 FROM (
 SELECT n.symbol, n.idx, p.p0, p.k, CASE WHEN floor((n.c - p.p0) / 8) > p.k THEN floor((n.c - p.p0) / 8)::BIGINT
   WHEN ceil((n.c - p.p0) / 8) < p.k THEN ceil((n.c - p.p0) / 8)::BIGINT ELSE p.k END AS k2
 FROM s p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1))
SELECT symbol, idx, way::BIGINT AS way FROM s""", price="floor(close)")
_chart("pf_trend", K.point_figure(8.0, 3), f"""WITH RECURSIVE b AS MATERIALIZED ({bars_sql()}),
s AS (SELECT symbol, idx, 0 AS kind, c AS edge FROM b WHERE idx = 0 UNION ALL
 SELECT n.symbol, n.idx,
  CASE WHEN p.kind = 0 THEN CASE WHEN n.c >= p.edge + 8 THEN 1 WHEN n.c <= p.edge - 8 THEN -1 ELSE 0 END
       WHEN p.kind = 1 AND n.c < p.edge + 8 AND n.c <= p.edge - 24 THEN -1
       WHEN p.kind = -1 AND n.c > p.edge - 8 AND n.c >= p.edge + 24 THEN 1 ELSE p.kind END,
  CASE WHEN p.kind = 0 THEN CASE WHEN abs(n.c - p.edge) >= 8 THEN floor(n.c / 8) * 8 ELSE p.edge END
       WHEN p.kind = 1 THEN CASE WHEN n.c >= p.edge + 8 OR n.c <= p.edge - 24 THEN floor(n.c / 8) * 8 ELSE p.edge END
       ELSE CASE WHEN n.c <= p.edge - 8 OR n.c >= p.edge + 24 THEN floor(n.c / 8) * 8 ELSE p.edge END END
 FROM s p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1)
SELECT symbol, idx, kind::BIGINT AS way FROM s""")
