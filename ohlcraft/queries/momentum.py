"""Momentum indicators over hourly bars."""

from __future__ import annotations

from ..functions import momentum as M
from ..functions import weights as W
from .base import ORD, Sql, avg, div, dot_sql, indicator, lag, mn, mx, sm, win, full

HEAD = "first_value({x}) OVER (PARTITION BY symbol ORDER BY {x} IS NULL, idx)"


def head(s: Sql, name: str, x: str, first: int) -> Sql:
    return s.add(**{name: f"CASE WHEN idx < {first} THEN {HEAD.format(x=x)} ELSE {x} END"})


def signal(s: Sql, out: str, x: str, n: int, first: int, blank: int) -> Sql:
    s = head(s, f"{out}_in", x, first).ema(f"{out}_e", f"{out}_in", n)
    return s.add(**{out: f"CASE WHEN idx >= {blank} THEN {out}_e END"})


def rsi_sql(s: Sql, out: str, x: str, n: int, first: int = 0) -> Sql:
    d = f"{out}_d"
    s = s.add(**{d: f"{x} - {lag(x)}"})
    s = s.add(**{f"{out}_gi": f"CASE WHEN idx = {first} THEN 0.0 ELSE greatest({d}, 0) END",
                 f"{out}_li": f"CASE WHEN idx = {first} THEN 0.0 ELSE greatest(-{d}, 0) END"})
    s = s.rma(f"{out}_g", f"{out}_gi", n, first).rma(f"{out}_l", f"{out}_li", n, first)
    g, l = f"{out}_g", f"{out}_l"
    return s.add(**{out: f"CASE WHEN {g} = 0 AND {l} = 0 THEN NULL WHEN {g} = 0 THEN 0.0 WHEN {l} = 0 THEN 100.0 "
                         f"ELSE 100 - 100 / (1 + {g} / {l}) END"})


def stoch_sql(x: str, n: int) -> str:
    return div(f"100 * ({x} - {mn(x, n)})", f"{mx(x, n)} - {mn(x, n)}")


indicator("ao", 40, M.ao, ["ao"], Sql().add(m="(h + l) / 2").add(ao=f"{avg('m', 5)} - {avg('m', 34)}").out("ao"))
indicator("apo", 30, M.apo, ["apo"], Sql().add(apo=f"{avg('c', 12)} - {avg('c', 26)}").out("apo"))
indicator("bias", 30, M.bias, ["bias"], Sql().add(m=avg("c", 26)).add(bias="c / m - 1").out("bias"))
indicator("bop", 0, M.bop, ["bop"], Sql().add(bop="CASE WHEN h = l THEN 0 ELSE (c - o) / (h - l) END").out("bop"))
indicator("brar", 30, M.brar, ["ar", "br"], Sql().add(p=lag("c")).add(
    ho="h - o", ol="o - l", hc="CASE WHEN p IS NOT NULL THEN greatest(h - p, 0) END",
    cl="CASE WHEN p IS NOT NULL THEN greatest(p - l, 0) END").add(
    s1=sm("ho", 26), s2=sm("ol", 26), s3=sm("hc", 26), s4=sm("cl", 26)).add(
    ar=div("100 * s1", "s2"), br=div("100 * s3", "s4")).out("ar", "br"))
indicator("cci", 20, M.cci, ["cci"], Sql().add(tp="(h + l + c) / 3").add(m=avg("tp", 14), a=f"list(tp) OVER {win(14)}").add(
    cci=div("tp - m", "0.015 * list_sum(list_transform(a, lambda x: abs(x - m))) / 14")).out("cci"))
indicator("cfo", 20, M.cfo, ["cfo"], Sql().add(sl=full("regr_slope(c, idx)", "c", 9), ic=full("regr_intercept(c, idx)", "c", 9)).add(
    cfo=div("100 * (c - (ic + sl * (idx + 1)))", "c")).out("cfo"))
indicator("cg", 20, M.cg, ["cg"], Sql().add(nu=dot_sql("c", [float(k) for k in range(1, 11)]), de=sm("c", 10)).add(
    cg=div("-nu", "de")).out("cg"))
indicator("cmo", 20, M.cmo, ["cmo"], Sql().add(d=f"c - {lag('c')}").add(u="greatest(d, 0)", w="greatest(-d, 0)").add(
    su=sm("u", 14), sw=sm("w", 14)).add(cmo=div("100 * (su - sw)", "su + sw")).out("cmo"))
indicator("coppock", 30, M.coppock, ["coppock"], Sql().add(r=div(f"100 * (c - {lag('c', 11)})", lag("c", 11)) + " + "
          + div(f"100 * (c - {lag('c', 14)})", lag("c", 14))).add(coppock=dot_sql("r", W.linear(10))).out("coppock"))
indicator("roc", 10, M.roc, ["roc"], Sql().add(roc=div(f"100 * (c - {lag('c', 10)})", lag("c", 10))).out("roc"))
indicator("rsi", 20, M.rsi, ["rsi"], rsi_sql(Sql(), "rsi", "c", 14).out("rsi"))
_STREAK = (Sql().add(sg=f"coalesce(sign(c - {lag('c')}), 0)").add(brk=f"CASE WHEN {lag('sg')} IS DISTINCT FROM sg THEN 1 ELSE 0 END")
           .add(isl=f"sum(brk) OVER {ORD}").add(streak="sg * row_number() OVER (PARTITION BY symbol, isl ORDER BY idx)"))
indicator("streak", 5, lambda f: M.streak(f, "streak"), ["streak"], _STREAK.out("streak"))
_CRSI = (Sql().add(sg=f"coalesce(sign(c - {lag('c')}), 0)").add(brk=f"CASE WHEN {lag('sg')} IS DISTINCT FROM sg THEN 1 ELSE 0 END")
         .add(isl=f"sum(brk) OVER {ORD}").add(streak="sg * row_number() OVER (PARTITION BY symbol, isl ORDER BY idx)"))
_CRSI = rsi_sql(rsi_sql(_CRSI, "r1", "c", 3), "r2", "streak", 2).add(a=f"list(c) OVER {win(100)}").add(
    pr="CASE WHEN len(a) = 100 THEN len(list_filter(a, lambda x: x < c)) / 99.0 * 100 END").add(crsi="(r1 + r2 + pr) / 3")
indicator("crsi", 110, M.crsi, ["crsi"], _CRSI.out("crsi"))
indicator("er", 15, M.er, ["er"], Sql().add(d=f"abs(c - {lag('c')})").add(er=div(f"abs(c - {lag('c', 10)})", sm("d", 10))).out("er"))
indicator("fisher", 15, M.fisher, ["fisher", "signal"], Sql().add(hi=mx("h", 9), lo=mn("l", 9)).add(
    p="0.66 * (" + div("(h + l + c) / 3 - lo", "hi - lo") + " - 0.5)").recur("raw", "p", 0.67, 8).recur("val", "0.5 * raw", 0.5, 8).add(
    fisher="0.5 * ln((1 + val) / (1 - val))").add(signal=lag("fisher")).out("fisher", "signal"))
_KST = Sql().add(**{f"k{i}": div(f"100 * (c - {lag('c', r)})", lag("c", r)) for i, r in enumerate((10, 15, 20, 30), 1)})
indicator("kst", 60, M.kst, ["kst", "signal"], _KST.add(
    kst=f"{avg('k1', 10)} + 2 * {avg('k2', 10)} + 3 * {avg('k3', 10)} + 4 * {avg('k4', 15)}").add(signal=avg("kst", 9)).out("kst", "signal"))
_MACD = signal(Sql().ema("f", "c", 12).ema("s", "c", 26).add(macd="f - s"), "signal", "macd", 9, 25, 33).add(hist="macd - signal")
indicator("macd", 40, M.macd, ["macd", "signal", "hist"], _MACD.out("macd", "signal", "hist"))
_MACDAS = signal(Sql().ema("f", "c", 12).ema("s", "c", 26).add(m0="f - s"), "s0", "m0", 9, 25, 33).add(macd="m0 - s0")
_MACDAS = signal(_MACDAS, "signal", "macd", 9, 33, 33).add(hist="macd - signal")
indicator("macd_as", 40, M.macd_as, ["macd", "signal", "hist"], _MACDAS.out("macd", "signal", "hist"))
_PPO = signal(Sql().ema("f", "c", 12).ema("s", "c", 26).add(ppo=div("100 * (f - s)", "s")), "signal", "ppo", 9, 25, 33).add(hist="ppo - signal")
indicator("ppo", 40, M.ppo, ["ppo", "signal", "hist"], _PPO.out("ppo", "signal", "hist"))
indicator("pgo", 20, M.pgo, ["pgo"], Sql().ema("e", "c", 14).add(pgo=div("c - e", f"{mx('h', 14)} - {mn('l', 14)}")).out("pgo"))
indicator("psl", 20, M.psl, ["psl"], Sql().add(p=lag("c")).add(u="CASE WHEN p IS NOT NULL THEN (c > p)::INT::DOUBLE END").add(
    psl=f"100 * {full('avg(u)', 'u', 12)}").out("psl"))
_STC = Sql().ema("f", "c", 12).ema("s", "c", 26).add(macd="f - s").add(k1=stoch_sql("macd", 10))
_STC = signal(_STC, "stoch", "k1", 3, 34, 36).add(k2=stoch_sql("stoch", 10))
_STC = signal(_STC, "stc", "k2", 3, 45, 47)
indicator("stc", 60, M.stc, ["stc", "macd", "stoch"], _STC.out("stc", "macd", "stoch"))
_RAW = div(f"100 * (c - {mn('l', 14)})", f"{mx('h', 14)} - {mn('l', 14)}")
indicator("stoch", 30, M.stoch, ["stoch_k", "stoch_d"], Sql().add(raw=_RAW).add(stoch_k=avg("raw", 3)).add(stoch_d=avg("stoch_k", 3)).out("stoch_k", "stoch_d"))
indicator("stochf", 30, M.stochf, ["stoch_k", "stoch_d"], Sql().add(stoch_k=_RAW).add(stoch_d=avg("stoch_k", 3)).out("stoch_k", "stoch_d"))
_SRSI = rsi_sql(Sql(), "rsi", "c", 14).add(cnt=f"count(rsi) OVER {win(14)}", lo=f"min(rsi) OVER {win(14)}", hi=f"max(rsi) OVER {win(14)}").add(
    st="CASE WHEN cnt < 14 THEN NULL WHEN hi = lo THEN 50 ELSE 100 * (rsi - lo) / (hi - lo) END").add(stoch_k=avg("st", 3)).add(stoch_d=avg("stoch_k", 3))
indicator("stochrsi", 50, M.stochrsi, ["stoch_k", "stoch_d"], _SRSI.out("stoch_k", "stoch_d"))
_TMO = signal(Sql().add(d=f"o - {lag('c')}").add(m=sm("d", 14)), "sg", "m", 4, 14, 17).add(tmo="m * 100 / 14", signal="sg * 100 / 14")
indicator("tmo", 40, M.tmo, ["tmo", "signal"], _TMO.out("tmo", "signal"))
_TSI = Sql().add(m=f"c - {lag('c')}").add(a="abs(m)")
_TSI = head(head(_TSI, "m0", "m", 1), "a0", "a", 1).ema("m1e", "m0", 13).ema("a1e", "a0", 13)
_TSI = _TSI.add(m1="CASE WHEN idx >= 13 THEN m1e END", a1="CASE WHEN idx >= 13 THEN a1e END")
_TSI = head(head(_TSI, "m1h", "m1", 13), "a1h", "a1", 13).ema("m2", "m1h", 25).ema("a2", "a1h", 25)
_TSI = signal(_TSI.add(tsi="CASE WHEN idx >= 37 THEN " + div("100 * m2", "a2") + " END"), "signal", "tsi", 13, 37, 49)
indicator("tsi", 60, M.tsi, ["tsi", "signal"], _TSI.out("tsi", "signal"))
_UO = Sql().add(p=lag("c")).add(bp="CASE WHEN p IS NOT NULL THEN c - least(l, p) END", tr="CASE WHEN p IS NOT NULL THEN greatest(h, p) - least(l, p) END")
_UO = _UO.add(**{f"q{n}": div(sm("bp", n), sm("tr", n)) for n in (7, 14, 28)}).add(uo="100 * (4 * q7 + 2 * q14 + q28) / 7")
indicator("uo", 40, M.uo, ["uo"], _UO.out("uo"))
indicator("willr", 20, M.willr, ["willr"], Sql().add(willr=div(f"-100 * ({mx('h', 14)} - c)", f"{mx('h', 14)} - {mn('l', 14)}")).out("willr"))
_CLOUD = rsi_sql(Sql().add(a4="(o + h + l + c) / 4"), "rsi", "a4", 14).ema("f", "rsi", 12, 13).ema("s", "rsi", 26, 13).add(
    macd="f - s").ema("signal", "macd", 9, 38).add(hist="macd - signal")
indicator("rsi_clouds", 40, M.rsi_clouds, ["rsi", "macd", "signal", "hist"], _CLOUD.out("rsi", "macd", "signal", "hist"))
