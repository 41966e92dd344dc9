"""Statistics, trend, volatility, volume and custom indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import avs as C
from ..functions import statistics as S
from ..functions import volatility as V
from ..sources import tables as T
from .base import (ORD, Sql, avg, bars_sql, div, framed, full, indicator, lag, mn, mx, query, register, rounded, sm, sr,
                   table_indicator, win)
from .momentum import rsi_sql

LIST = "CASE WHEN count(c) OVER {w} = {n} THEN list(c) OVER {w} END"


def arr(n: int) -> str:
    return LIST.format(w=win(n), n=n)


indicator("entropy", 10, lambda f: S.entropy(f.add(close=F.floor("close").cast("double"))), ["entropy"],
          Sql().add(c2="floor(c)").add(a=f"CASE WHEN count(c) OVER {win(10)} = 10 THEN list(c2) OVER {win(10)} END").add(
              entropy="-list_sum(list_transform(list_distinct(a), lambda v: len(list_filter(a, lambda u: u = v)) / 10.0 "
                      "* ln(len(list_filter(a, lambda u: u = v)) / 10.0))) / ln(2)").out("entropy"))
indicator("kurtosis", 30, S.kurtosis, ["kurtosis"], Sql().add(kurtosis=full("kurtosis(c)", "c", 30)).out("kurtosis"))
indicator("skew", 30, S.skew, ["skew"], Sql().add(skew=full("skewness(c)", "c", 30)).out("skew"))
indicator("mad", 30, S.mad, ["mad"], Sql().add(a=arr(30)).add(
    mad="list_sum(list_transform(a, lambda x: abs(x - list_sum(a) / 30))) / 30").out("mad"))
indicator("median", 30, S.median, ["median"], Sql().add(median=full("median(c)", "c", 30)).out("median"))
indicator("quantile", 30, lambda f: S.quantile(f, 30, 0.25), ["quantile"], Sql().add(quantile=f"list_sort({arr(30)})[8]").out("quantile"))
indicator("stdev", 30, lambda f: S.stdev(f), ["close_stdev"], Sql().add(close_stdev=full("stddev_samp(c)", "c", 30)).out("close_stdev"))
indicator("stdev_multi", 30, lambda f: S.stdev(f, 30, 0, ("open", "high", "low", "close")),
          [f"{x}_stdev" for x in ("open", "high", "low", "close")],
          Sql().add(**{f"{x}_stdev": full(f"stddev_pop({x[0]})", x[0], 30) for x in ("open", "high", "low", "close")}).out(
              *[f"{x}_stdev" for x in ("open", "high", "low", "close")]))
indicator("variance", 30, S.variance, ["variance"], Sql().add(variance=full("var_samp(c)", "c", 30)).out("variance", digits=4), digits=4)
indicator("zscore", 30, S.zscore, ["zscore"], Sql().add(zscore=div(f"c - {avg('c', 30)}", full("stddev_samp(c)", "c", 30))).out("zscore"))

_BAND = ["lr", "l_1", "u_1", "l_2", "u_2", "l_3", "u_3"]
_BAND_SQL = """, q AS (SELECT * FROM b0 QUALIFY idx > max(idx) OVER (PARTITION BY symbol) - {n}),
k AS (SELECT symbol, regr_slope(c, idx) AS b, regr_intercept(c, idx) AS a, stddev_samp(c) AS s FROM q GROUP BY symbol),
z AS (SELECT q.symbol, q.idx, a + b * q.idx AS lr, s FROM q JOIN k USING (symbol))
SELECT symbol, idx, {cols} FROM z"""
for _n, _name in ((50, "tos_stdevall"), (10**9, "tos_stdevall_all")):
    table_indicator(_name, lambda b, n=_n: S.regression_band(b, None if n == 10**9 else n), _BAND,
                    f"WITH b0 AS ({bars_sql()})" + _BAND_SQL.format(n=_n, cols=", ".join(
                        [f"{sr('lr')} AS lr"] + [f"{sr(f'lr {s} {m} * s')} AS {d}_{m}" for m in (1, 2, 3) for s, d in (("-", "l"), ("+", "u"))])))

TR = "greatest(h - l, abs(h - p), abs(l - p))"


def tr_sql(s: Sql | None = None) -> Sql:
    return (s or Sql()).add(p=lag("c")).add(tr=f"CASE WHEN p IS NOT NULL THEN {TR} END")


indicator("true_range", 2, V.true_range, ["true_range"], tr_sql().add(true_range="tr").out("true_range"))
indicator("atr", 20, V.atr, ["atr"], tr_sql().rma("atr", "tr", 14, 1).out("atr"))
indicator("atr_sma_percent", 20, lambda f: V.atr(f, mode="sma", percent=True), ["atr"], tr_sql().add(
    a=avg("tr", 14)).add(atr="100 * a / c").out("atr"))
indicator("atr_ema", 20, lambda f: V.atr(f, mode="ema"), ["atr"], tr_sql().ema("atr", "tr", 14, 1).out("atr"))
indicator("research_atr", 20, V.research_atr, ["atr"], Sql().add(p=f"coalesce({lag('c')}, c)").add(tr=TR).add(
    a0=f"avg(tr) OVER {win(14)}").add(atr="CASE WHEN a0 <= 0 THEN 1e-6 ELSE a0 END").out("atr"))
indicator("aberration", 20, V.aberration, ["zg", "sg", "xg", "atr"], tr_sql().rma("atr", "tr", 15, 1).add(tp="(h + l + c) / 3").add(
    zg=avg("tp", 5)).add(sg="zg + atr", xg="zg - atr").out("zg", "sg", "xg", "atr"))
indicator("accbands", 20, V.accbands, ["lower", "mid", "upper"], Sql().add(w="4 * (h - l) / (h + l)").add(
    lo="l * (1 - w)", hi="h * (1 + w)").add(lower=avg("lo", 20), mid=avg("c", 20), upper=avg("hi", 20)).out("lower", "mid", "upper"))
indicator("bbands", 20, V.bbands, ["lower", "mid", "upper", "bandwidth", "percent_b"], Sql().add(mid=avg("c", 20), sd=full("stddev_samp(c)", "c", 20)).add(
    lower="mid - 2 * sd", upper="mid + 2 * sd").add(bandwidth="100 * (upper - lower) / mid", percent_b=div("c - lower", "upper - lower")).out(
    "lower", "mid", "upper", "bandwidth", "percent_b"))
_ADX = tr_sql(Sql().add(u=f"h - {lag('h')}", d=f"{lag('l')} - l")).add(
    pos="CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", neg="CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END").rma(
    "a", "tr", 14, 1).rma("ps", "pos", 14).rma("ns", "neg", 14).add(dmp="100 * ps / a", dmn="100 * ns / a").add(
    dx=div("100 * abs(dmp - dmn)", "dmp + dmn")).rma("adx", "dx", 14, 14).add(adxr=f"0.5 * (adx + {lag('adx', 2)})")
indicator("adx", 30, V.adx, ["adx", "adxr", "dmp", "dmn"], _ADX.out("adx", "adxr", "dmp", "dmn"))
indicator("rwi", 30, V.rwi, ["rwi_high", "rwi_low"], tr_sql().rma("a", "tr", 14, 1).add(
    rwi_high=div(f"h - {lag('l', 14)}", "a * sqrt(14)"), rwi_low=div(f"{lag('h', 14)} - l", "a * sqrt(14)")).out("rwi_high", "rwi_low"))
indicator("vwma", 15, V.vwma, ["vwma"], Sql().add(pv="c * v").add(vwma=div(avg("pv", 10), avg("v", 10))).out("vwma"))

ST_LOOP = """, st AS (
 SELECT symbol, idx, lo AS up, hi AS dn, 1 AS way, NULL::DOUBLE AS trend FROM $b WHERE idx = 0
 UNION ALL
 SELECT symbol, idx, CASE WHEN w > 0 AND pup > lo THEN pup ELSE lo END, CASE WHEN w < 0 AND pdn < hi THEN pdn ELSE hi END, w,
        CASE WHEN w > 0 THEN (CASE WHEN pup > lo THEN pup ELSE lo END) ELSE (CASE WHEN pdn < hi THEN pdn ELSE hi END) END
 FROM (SELECT n.symbol, n.idx, n.lo, n.hi, p.up AS pup, p.dn AS pdn,
              CASE WHEN n.c > p.dn THEN 1 WHEN n.c < p.up THEN -1 ELSE p.way END AS w
       FROM st p JOIN $b n ON n.symbol = p.symbol AND n.idx = p.idx + 1))
"""


def supertrend_sql(n: int, k: float) -> tuple[str, str]:
    s = tr_sql().rma("a", "tr", n, 1).add(lo=f"(h + l) / 2 - {k} * a", hi=f"(h + l) / 2 + {k} * a")
    return s.text("") + ST_LOOP.replace("$b", s.last), s.last


table_indicator("supertrend", lambda b: V.supertrend(b), ["trend", "side", "long", "short"], supertrend_sql(7, 3.0)[0] + f"""
SELECT symbol, idx, {sr('trend')} AS trend, CASE WHEN idx > 0 THEN way::DOUBLE END AS side,
 CASE WHEN way > 0 THEN {sr('trend')} END AS long, CASE WHEN way < 0 THEN {sr('trend')} END AS short FROM st""")
_TS = tr_sql().ema("a", "tr", 14, 1).ema("m", "c", 20)
table_indicator("atrts", lambda b: V.atrts(b), ["stop", "side"], _TS.text("") + f""", st AS (
 SELECT symbol, idx, CASE WHEN c > m THEN c - 3 * a ELSE c + 3 * a END AS stop, CASE WHEN c > m THEN 1.0 ELSE -1.0 END AS side FROM {_TS.last} WHERE idx = 20
 UNION ALL SELECT n.symbol, n.idx, CASE WHEN n.c > n.m THEN greatest(n.c - 3 * n.a, p.stop) ELSE least(n.c + 3 * n.a, p.stop) END,
  CASE WHEN n.c > n.m THEN 1.0 ELSE -1.0 END FROM st p JOIN {_TS.last} n ON n.symbol = p.symbol AND n.idx = p.idx + 1)
SELECT b.symbol, b.idx, {sr('st.stop')} AS stop, st.side::DOUBLE AS side FROM b0 b LEFT JOIN st ON st.symbol = b.symbol AND st.idx = b.idx""")

_HA = Sql().add(ha_close="(o + h + l + c) / 4").add(bb=f"CASE WHEN idx = 0 THEN (o + c) / 2 ELSE 0.5 * {lag('ha_close')} END").recur(
    "ha_open", "bb", 0.5, 0).add(ha_high="greatest(ha_open, ha_close, h)", ha_low="least(ha_open, ha_close, l)")
indicator("heikin_ashi", 5, V.heikin_ashi, ["ha_open", "ha_high", "ha_low", "ha_close"], _HA.out("ha_open", "ha_high", "ha_low", "ha_close", digits=5), digits=5)

_LEVELS = {
    "traditional": ("(h+l+c)/3", "2*tp-h", "tp-r", "tp-2*r", "tp-2*r", "2*tp-l", "tp+r", "tp+2*r", "tp+2*r"),
    "classic": ("(h+l+c)/3", "2*tp-h", "tp-r", "tp-2*r", "tp-3*r", "2*tp-l", "tp+r", "tp+2*r", "tp+3*r"),
    "camarilla": ("(h+l+c)/3", "c-11*r/120", "c-11*r/60", "c-0.275*r", "c-0.55*r", "c+11*r/120", "c+11*r/60", "c+0.275*r", "c+0.55*r"),
    "fibonacci": ("(h+l+c)/3", "tp-0.382*r", "tp-0.618*r", "tp-r", "NULL", "tp+0.382*r", "tp+0.618*r", "tp+r", "NULL"),
    "woodie": ("(2*o+h+l)/4", "2*tp-h", "tp-r", "l-2*(h-tp)", "l-2*(h-tp)-r", "2*tp-l", "tp+r", "h+2*(tp-l)", "h+2*(tp-l)+r"),
    "demark": ("CASE WHEN o=c THEN (h+l+2*c)/4 WHEN c>o THEN (2*h+l+c)/4 ELSE (h+2*l+c)/4 END", "2*tp-h", "NULL", "NULL", "NULL",
               "2*tp-l", "NULL", "NULL", "NULL"),
}
_NAMES = ["p", "s1", "s2", "s3", "s4", "r1", "r2", "r3", "r4"]
for _m, _lv in _LEVELS.items():
    for _anchor, _unit in (("D", "day"), ("W", "week")) if _m == "traditional" else (("D", "day"),):
        _cols = ", ".join(f"lag({e if n != 'p' else 'tp'}) OVER (PARTITION BY symbol ORDER BY d) AS {n}" for n, e in zip(_NAMES, ("tp",) + _lv[1:]))
        _q = f"""WITH b AS ({bars_sql()}), x AS (SELECT *, date_trunc('{_unit}', make_timestamp(ts * 1000)) AS d FROM b),
 g AS (SELECT symbol, d, arg_min(o, idx) AS o, max(h) AS h, min(l) AS l, arg_max(c, idx) AS c, max(h) - min(l) AS r FROM x GROUP BY 1, 2),
 t AS (SELECT *, {_lv[0]} AS tp FROM g), pv AS (SELECT symbol, d, {_cols} FROM t)
 SELECT x.symbol, x.idx, {', '.join(f"{sr(n)} AS {n}" for n in _NAMES)} FROM x JOIN pv USING (symbol, d)"""
        table_indicator(f"pivots_{_m}" + ("_week" if _anchor == "W" else ""), lambda b, m=_m, a=_anchor: V.pivots(b, m, a), _NAMES, _q)


@query("ichimoku_forward", f"""WITH b AS ({bars_sql()}), m AS (SELECT *, max(idx) OVER (PARTITION BY symbol) AS li, max(ts) OVER (PARTITION BY symbol) AS lt,
 ({mx('h', 9)} + {mn('l', 9)}) / 2 AS t, ({mx('h', 26)} + {mn('l', 26)}) / 2 AS k, ({mx('h', 52)} + {mn('l', 52)}) / 2 AS s FROM b)
SELECT symbol, idx + 26 AS idx, lt + (idx + 26 - li) * 3600000 AS ts, {sr('(t + k) / 2')} AS span_a, {sr('s')} AS span_b FROM m WHERE idx > li - 26""")
def ichimoku_forward(spark, sf_dir):
    f = V.ichimoku(framed(spark, sf_dir, 60))
    return rounded(V.ichimoku_forward(f, 3_600_000), ["symbol", "idx", "ts"], ["span_a", "span_b"])


def avs_sql(fast: int, slow: int, k: float, out: str, price: str, sign: str, fill: bool = False, source: str | None = None) -> Sql:
    s = Sql(source).add(pv="c * v").add(wf=div(avg("pv", fast), avg("v", fast)), ws=div(avg("pv", slow), avg("v", slow)),
                        sf=avg("c", fast), ss=avg("c", slow), vf=avg("v", fast), vs=avg("v", slow))
    s = s.add(vpc="ws - ss", vpr=div("wf", "sf"), vm=div("vf", "vs")).add(vpci="vpc * vpr * vm").add(dev=f"{k} * vpci * vm")
    s = s.add(ln="CASE WHEN vpci IS NULL THEN 1 WHEN vpc < 0 THEN floor(abs(vpci - 3) + 0.5) ELSE floor(vpci + 3.5) END",
              un="CASE WHEN vpc > -1 AND vpc < 0 THEN -1 WHEN vpc >= 0 AND vpc < 1 THEN 1 ELSE vpc END")
    s = s.add(adj=f"CASE WHEN un IS NULL OR vpr IS NULL THEN NULL WHEN un = 0 OR vpr = 0 THEN 0 ELSE {price} / (un * vpr) END")
    src = s.last
    s = s.step(f"SELECT a.*, CASE WHEN a.ln <= 0 THEN a.{price} ELSE g.tot / a.ln / 100 END AS prv FROM {src} a LEFT JOIN ("
               f"SELECT t.symbol, t.idx, CASE WHEN count(*) = count(s.adj) THEN sum(s.adj) END AS tot FROM {src} t JOIN {src} s "
               f"ON s.symbol = t.symbol AND s.idx <= t.idx AND s.idx > t.idx - t.ln GROUP BY 1, 2) g ON g.symbol = a.symbol AND g.idx = a.idx")
    s = s.add(ad0=f"{price} - prv + dev" if sign == "+" else f"{price} + prv - dev")
    s = s.add(ad=f"last_value(ad0 IGNORE NULLS) OVER {ORD}" if fill else "ad0")
    return s.add(**{out: avg("ad", slow)})


table_indicator("avsl", lambda b: C.avsl(b), ["avsl"], avs_sql(5, 20, 1.0, "avsl", "l", "+").out("avsl"))
table_indicator("avsr", lambda b: C.avsr(b), ["avsr"], avs_sql(5, 20, 1.0, "avsr", "h", "-").out("avsr"))
table_indicator("fast_line", lambda b: C.fast_line(b, 10, 40), ["line"], avs_sql(10, 40, 2.0, "line", "l", "+", True).out("line"))
_AVS = Sql().add(pv="c * v").add(wf=div(avg("pv", 5), avg("v", 5)), ws=div(avg("pv", 20), avg("v", 20)), sf=avg("c", 5), ss=avg("c", 20),
                                 vf=avg("v", 5), vs=avg("v", 20)).add(vpc="ws - ss", vpr=div("wf", "sf"), vm=div("vf", "vs")).add(
    vpci="vpc * vpr * vm").add(dev="vpci * vm")
indicator("avs_base", 20, lambda f: C.avs_base(f, 5, 20), ["vpc", "vpr", "vm", "vpci", "dev"], _AVS.out("vpc", "vpr", "vm", "vpci", "dev"))

_CH1 = avs_sql(5, 20, 1.0, "avsl", "l", "+").text("SELECT symbol, idx, c, avsl FROM $")
_CH2 = avs_sql(5, 20, 1.0, "avsr", "h", "-").text("SELECT symbol, idx, avsr FROM $")


@query("avs_channel", f"""WITH x AS (SELECT * FROM ({_CH1}) JOIN ({_CH2}) USING (symbol, idx)), y AS (SELECT *, c >= avsl AND c <= avsr AS inside FROM x),
z AS (SELECT *, {lag('inside')} AS was FROM y) SELECT symbol, idx, inside, was AND c > avsr AS break_up, was AND c < avsl AS break_down FROM z""")
def avs_channel(spark, sf_dir):
    from ..operators.frames import Frame

    both = C.avsr(C.avsl(T.bars(spark, sf_dir)))
    return C.channel_state(Frame.of_numbered(both, 2)).core("symbol", "idx", "inside", "break_up", "break_down")


# direction needs the previous state, so the twin walks bar by bar
def _ott_sql(s: Sql) -> str:
    s = s.add(ls=f"max(ma - ma * 1.4 / 100) OVER {ORD}", ss=f"min(ma + ma * 1.4 / 100) OVER {ORD}")
    s = s.add(pls=lag("ls"), pss=lag("ss"))
    s = s.loop("dir", "1", "CASE WHEN p.dir = -1 AND n.ma > n.pss THEN 1 WHEN p.dir = 1 AND n.ma < n.pls THEN -1 ELSE p.dir END")
    s = s.add(st="CASE WHEN dir = 1 THEN ls ELSE ss END", long_stop="ls", short_stop="ss").add(
        ott="CASE WHEN ma > st THEN st * 201.4 / 200 ELSE st * 198.6 / 200 END")
    return s.out("ma", "long_stop", "short_stop", "dir", "ott")


_OUT = ["ma", "long_stop", "short_stop", "dir", "ott"]
_VAR = (Sql().add(d=f"coalesce(c - {lag('c')}, 0)").add(u="greatest(d, 0)", w="greatest(-d, 0)").add(su=sm("u", 9), sw=sm("w", 9))
        .add(k=f"coalesce({2 / 3} * abs(CASE WHEN su + sw = 0 THEN 0 ELSE (su - sw) / (su + sw) END), 0)")
        .loop("ma", "n.c", "n.k * n.c + (1 - n.k) * p.ma"))
indicator("ott", 20, lambda f: C.ott(f), _OUT, _ott_sql(_VAR), size=512)
for _mode, _s in (("SMA", Sql().add(ma=avg("c", 4))), ("EMA", Sql().ema("ma", "c", 4)), ("WWMA", Sql().recur("ma", "c * CASE WHEN idx = 0 THEN 1.0 ELSE 0.25 END", 0.75, 0)),
                  ("TMA", Sql().add(m=avg("c", 2)).add(ma=avg("m", 3))), ("ZLEMA", Sql().add(z=f"2 * c - {lag('c', 2)}").ema("ma", "z", 4, 2)),
                  ("TSF", Sql().add(sl=full("regr_slope(c, idx)", "c", 4), ic=full("regr_intercept(c, idx)", "c", 4)).add(ma="ic + sl * (idx + 1)"))):
    indicator(f"ott_{_mode.lower()}", 20, lambda f, m=_mode: C.ott(f, 4, 1.4, m), _OUT, _ott_sql(_s))

# a cycle of three leaves no warm-up gap in the smoother
_SC = (Sql().add(d=f"coalesce(c - {lag('c')}, 0)").add(mu="greatest(d, 0)", md="greatest(-d, 0)")
       .add(r0="CASE WHEN mu = 0 AND md = 0 THEN 50 WHEN mu = 0 THEN 0 WHEN md = 0 THEN 100 ELSE 100 - 100 / (1 + mu / md) END")
       .add(rsi="(r0 - 50) * 2").add(bb=f"0.5 * (2 * rsi - {lag('rsi')})").recur("cr", "bb", 0.5, 1).add(crsi="coalesce(cr, 0)"))
indicator("scrsi", 10, lambda f: C.scrsi(f, 3, 3), ["rsi", "crsi"], _SC.out("rsi", "crsi"))
register("scrsi_bands", lambda spark, d: rounded(C.scrsi_bands(C.scrsi(framed(spark, d, 10), 3, 3).core(), 3, 10.0), ["symbol"], ["lower", "upper"]),
         _SC.text(f"SELECT symbol, {sr('quantile_cont(crsi, 0.1)')} AS lower, {sr('quantile_cont(crsi, 0.9)')} AS upper FROM $ WHERE idx < 6 GROUP BY symbol"))
