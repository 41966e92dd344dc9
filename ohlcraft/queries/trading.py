"""Events, outcomes, streams, statistics and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import averages as A
from ..functions import rolling as R
from ..functions.volatility import atr, research_atr
from ..operators.frames import DAY_MS, HOUR_MS, Frame, number_bars
from ..plans import outcomes as O
from ..plans import inference as IN
from ..plans import portfolio as P
from ..plans import rulebook as RB
from ..plans import signals as G
from ..sources import tables as T
from ..sources.store import settled, stored
from .base import ORD, Sql, avg, bars_sql, full, indicator, lag, query, r6, rounded, sr, win
from .volatility import tr_sql

c = F.col

# -- shared derived tables and their SQL twins -------------------------------
_SIG = tr_sql().add(fa=avg("c", 5), sl=avg("c", 20), atr=avg("tr", 14)).add(pf=lag("fa"), ps=lag("sl"), nxt_o=f"lead(o) OVER {ORD}").add(
    up="coalesce(fa > sl AND pf < ps, false)", dn="coalesce(fa < sl AND pf > ps, false)", last_idx="max(idx) OVER (PARTITION BY symbol)")
SIG = _SIG.text("").replace("WITH RECURSIVE ", "").rstrip() + f", s AS MATERIALIZED (SELECT * FROM {_SIG.last})"
EV = SIG + """, ev AS MATERIALIZED (SELECT symbol, idx, ts, c AS close, atr, up AS is_long, 2 * atr AS risk, CASE WHEN up THEN 1 ELSE -1 END AS sg FROM s WHERE (up OR dn) AND idx >= 30 AND atr > 0)"""


def outcome_sql(h: int, goal: str, name: str = "tr") -> str:
    return f""", {name}p AS (SELECT e.symbol, e.idx, s.idx AS j, s.c AS jc, CASE WHEN (is_long AND s.l <= close - risk) OR (NOT is_long AND s.h >= close + risk) THEN 0
  WHEN (is_long AND s.h >= close + {goal} * risk) OR (NOT is_long AND s.l <= close - {goal} * risk) THEN 1 END AS kind FROM ev e JOIN s ON s.symbol = e.symbol AND s.idx > e.idx AND s.idx <= e.idx + {h}),
{name}h AS (SELECT symbol, idx, min(CASE WHEN kind IS NOT NULL THEN j * 2 + kind END) AS code, max(j) AS lj, arg_max(jc, j) AS lc FROM {name}p GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT e.*, coalesce(code // 2, lj, e.idx) AS exit_idx, CASE WHEN code IS NULL THEN 'time' WHEN code % 2 = 0 THEN 'sl' ELSE 'tp' END AS reason,
 CASE WHEN code IS NULL THEN sg * (coalesce(lc, close) - close) / risk WHEN code % 2 = 0 THEN -1 ELSE {goal} END AS gross, 2 * 0.0005 * close / risk AS fee FROM ev e LEFT JOIN {name}h USING (symbol, idx))"""


TR = EV + outcome_sql(24, "3")
_PRICED = "SELECT symbol, min(ts) AS g0 FROM s GROUP BY symbol"
BOOK = TR + """, g AS (SELECT min(ts) AS g0, max(ts) AS g1 FROM s), bk AS MATERIALIZED (SELECT tr.*, gross - fee AS net, (tr.ts - g0) // 3600000 AS e0, (x.ts - g0) // 3600000 AS e1, (g1 - g0) // 3600000 + 1 AS n
 FROM tr JOIN s x ON x.symbol = tr.symbol AND x.idx = tr.exit_idx, g)"""
# accrual stream: every trade spreads net/(hold+1) over its bars
STREAM = BOOK + """, st AS MATERIALIZED (SELECT i.idx, coalesce(sum(net / (greatest(e1 - e0, 1) + 1)), 0) AS r, count(net) AS n_open FROM (SELECT unnest(range(0, (SELECT max(n) FROM bk))) AS idx) i
 LEFT JOIN bk ON i.idx BETWEEN e0 AND e1 GROUP BY i.idx)"""


def sig(spark, d):
    return stored(spark, "average_cross", d, lambda: RB.average_cross(T.bars(spark, d)))


def trades(spark, d):
    return stored(spark, "cross_trades", d, lambda: RB.trades_of(sig(spark, d), T.bars(spark, d), RB.cross_rule()))


def book(spark, d):
    """Trades on the global grid in one book, unit size."""
    def build():
        t, _ = RB.on_grid(trades(spark, d), T.bars(spark, d), HOUR_MS)
        return t.withColumns({"book": F.lit("all"), "size": F.lit(1.0)})

    return stored(spark, "cross_book", d, build)


def grid_size(spark, d):
    _, n = RB.on_grid(trades(spark, d), T.bars(spark, d), HOUR_MS)
    return n.select(F.lit("all").alias("book"), "n")


def stream(spark, d):
    return stored(spark, "cross_stream", d, lambda: P.accrual(book(spark, d), grid_size(spark, d)))


# -- flagship ---------------------------------------------------------------
@query("average_cross_report", "WITH " + TR + f"""SELECT symbol, count(*) AS n, {sr('avg(gross - fee)')} AS mean_r, {sr('avg((gross - fee > 0)::INT)')} AS win_rate, {sr('sum(gross - fee)')} AS total_r FROM tr GROUP BY symbol""")
def average_cross_report(spark, d):
    t = trades(spark, d)
    g = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_r"), F.avg((c("net") > 0).cast("double")).alias("win_rate"), F.sum("net").alias("total_r"))
    return rounded(g, ["symbol", "n"], ["mean_r", "win_rate", "total_r"])


@query("cross_trades", "WITH " + TR + f"SELECT symbol, idx, is_long, exit_idx, reason, {sr('gross')} AS gross, {sr('fee')} AS fee FROM tr")
def cross_trades(spark, d):
    return trades(spark, d).select("symbol", "idx", "is_long", "exit_idx", "reason", r6("gross").alias("gross"), r6("fee").alias("fee"))


@query("rule_with_stop_line", "WITH " + EV.replace("2 * atr AS risk", "greatest(abs(c - sl), 2 * atr) AS risk") + outcome_sql(24, "5") + f"SELECT symbol, idx, exit_idx, reason, {sr('gross - fee')} AS net FROM tr")
def rule_with_stop_line(spark, d):
    rule = G.Rule("line", c("cross_up"), c("cross_down"), stop_line=c("slow"), k_atr=2.0, target_r=5.0, horizon=24, warmup=30)
    return RB.trades_of(sig(spark, d), T.bars(spark, d), rule).select("symbol", "idx", "exit_idx", "reason", r6("net").alias("net"))


FILL = EV + """, f AS (SELECT ev.*, s.idx AS fill_idx, s.o * (1 + sg * 0.0005) AS fill, ev.close - sg * risk AS stop, s.o * (1 + sg * 0.0005) + sg * 2 * abs(s.o * (1 + sg * 0.0005) - (ev.close - sg * risk)) AS target
 FROM ev JOIN s ON s.symbol = ev.symbol AND s.idx = ev.idx + 1)"""


def fills(spark, d, slip=0.0005):
    b = T.bars(spark, d)
    ev = G.entries(sig(spark, d), RB.cross_rule()).select("symbol", "idx", "ts", "close", "atr", "is_long", "risk")
    nxt = b.select("symbol", (c("idx") - 1).alias("idx"), c("open").alias("_o"))
    ev = ev.join(nxt, ["symbol", "idx"]).withColumns({"fill_idx": c("idx") + 1, "fill": c("_o") * (1 + O.sign() * slip), "stop": c("close") - O.sign() * c("risk")})
    return ev.withColumn("target", c("fill") + O.sign() * 2 * F.abs(c("fill") - c("stop"))).drop("_o")


def _walk(h: int) -> str:
    return f""", fp AS (SELECT f.symbol, f.idx, s.idx AS j, s.c AS jc, CASE WHEN (is_long AND s.l <= stop) OR (NOT is_long AND s.h >= stop) THEN 0 WHEN (is_long AND s.h >= target) OR (NOT is_long AND s.l <= target) THEN 1 END AS kind
 FROM f JOIN s ON s.symbol = f.symbol AND s.idx BETWEEN f.fill_idx AND f.fill_idx + {h}), fh AS (SELECT symbol, idx, min(CASE WHEN kind IS NOT NULL THEN j * 2 + kind END) AS code, max(j) AS lj, arg_max(jc, j) AS lc FROM fp GROUP BY 1, 2)"""


_BO = FILL + _walk(24) + """, o AS (SELECT f.*, abs(fill - stop) AS ru, coalesce(code // 2, CASE WHEN lj = fill_idx + 24 THEN lj END) AS exit_idx,
 CASE WHEN code % 2 = 0 THEN 'sl' WHEN code % 2 = 1 THEN 'tp' WHEN lj = fill_idx + 24 THEN 'time' END AS exit_reason,
 CASE WHEN code % 2 = 0 THEN stop * (1 - sg * 0.0005) WHEN code % 2 = 1 THEN target WHEN lj = fill_idx + 24 THEN lc * (1 - sg * 0.0005) END AS exit_price FROM f JOIN fh USING (symbol, idx)),
o2 AS (SELECT *, sg * (exit_price - fill) / ru - (2 * 0.001 + 0.0005) * fill / ru AS r_net FROM o)"""
_PESS = ("r_net - 2 * 0.0005 * fill / ru - CASE WHEN exit_reason = 'sl' THEN 0.0005 * abs(stop) / ru + 0.25 * atr / ru "
         "WHEN exit_reason = 'time' THEN 0.0005 * abs(exit_price) / ru ELSE 0 END")


@query("barrier_outcome", "WITH " + _BO + f"SELECT symbol, idx, exit_idx, exit_reason, {sr('exit_price')} AS exit_price, {sr('r_net')} AS r_net FROM o2")
def barrier_outcome(spark, d):
    o = O.barrier_outcome(fills(spark, d), T.bars(spark, d), ["symbol", "idx"], 24, 0.001, 0.0005)
    return rounded(o, ["symbol", "idx", "exit_idx", "exit_reason"], ["exit_price", "r_net"])


@query("pessimistic_costs", "WITH " + _BO + f"SELECT symbol, idx, {sr(_PESS)} AS r_pess FROM o2")
def pessimistic_costs(spark, d):
    o = O.barrier_outcome(fills(spark, d), T.bars(spark, d), ["symbol", "idx"], 24, 0.001, 0.0005)
    return rounded(O.pessimistic(o), ["symbol", "idx"], ["r_pess"])


@query("stress_grid", "WITH " + _BO + f", q AS (SELECT unnest([0.25, 0.5])::DOUBLE AS gap) SELECT gap, count(r_net) AS n, {sr('avg(' + _PESS.replace('0.25 * atr', 'gap * atr') + ')')} AS ev FROM o2, q GROUP BY gap")
def stress_grid(spark, d):
    o = O.barrier_outcome(fills(spark, d), T.bars(spark, d), ["symbol", "idx"], 24, 0.001, 0.0005)
    parts = [O.pessimistic(o, gap=g).select(F.lit(g).alias("gap"), "r_net", "r_pess") for g in (0.25, 0.5)]
    return rounded(parts[0].unionByName(parts[1]).groupBy("gap").agg(F.count("r_net").alias("n"), F.avg("r_pess").alias("ev")), ["gap", "n"], ["ev"])


@query("maker_outcome", "WITH " + FILL + _walk(47) + f""", k AS (SELECT f.*, abs(fill - stop) AS ru, code, lj, lc FROM f JOIN fh USING (symbol, idx)), m AS (SELECT *, (0.001 * 1.3 + 0.0005) * fill / ru + 2 * 0.0005 * fill / ru AS cost FROM k)
SELECT symbol, idx, {sr('''CASE WHEN ru > 0 THEN CASE WHEN sg * (fill - stop) < 0 THEN -cost - 0.0005 * fill / ru WHEN code % 2 = 0 THEN sg * (stop * (1 - sg * 0.0005) - fill) / ru - cost - 0.0005 * stop / ru - 0.25 * atr / ru
 WHEN code % 2 = 1 THEN sg * (target - fill) / ru - cost WHEN lj = fill_idx + 47 THEN sg * (lc * (1 - sg * 0.0005) - fill) / ru - cost - 0.0005 * abs(lc * (1 - sg * 0.0005)) / ru END END''')} AS r_pess FROM m""".replace("0.0005 * stop / ru", "0.0005 * abs(stop) / ru"))
def maker_outcome(spark, d):
    return rounded(O.maker_outcome(fills(spark, d), T.bars(spark, d), ["symbol", "idx"]), ["symbol", "idx"], ["r_pess"])


@query("reverse_exit", "WITH " + EV + f""", nx AS (SELECT e.*, (SELECT min(q.idx) FROM ev q WHERE q.symbol = e.symbol AND q.idx > e.idx AND q.is_long <> e.is_long) AS nn, (SELECT max(idx) FROM s WHERE s.symbol = e.symbol) AS lx FROM ev e),
y AS (SELECT *, CASE WHEN nn IS NULL THEN lx ELSE least(nn, idx + 60) END AS xo FROM nx), z AS (SELECT y.symbol, y.idx, min(CASE WHEN (is_long AND s.l <= close - risk) OR (NOT is_long AND s.h >= close + risk) THEN s.idx END) AS si, arg_max(s.c, s.idx) AS lc
 FROM y JOIN s ON s.symbol = y.symbol AND s.idx > y.idx AND s.idx <= y.xo GROUP BY 1, 2)
SELECT y.symbol, y.idx, coalesce(si, least(xo, lx)) AS exit_idx, CASE WHEN si IS NOT NULL THEN 'sl' ELSE 'reverse' END AS reason,
 {sr('CASE WHEN si IS NOT NULL THEN -1 ELSE sg * (coalesce(lc, close) - close) / risk END - 2 * 0.0005 * close / risk')} AS net FROM y LEFT JOIN z USING (symbol, idx)""")
def reverse_exit(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule())
    return O.reverse_exit(ev, T.bars(spark, d), 60).select("symbol", "idx", "exit_idx", "reason", r6("net").alias("net"))


@query("trailing_exit", "WITH " + EV + f""", y AS (SELECT e.symbol, e.idx, e.close, e.risk, e.atr, e.is_long, e.sg, s.idx AS j, s.h, s.l, s.c AS jc FROM ev e JOIN s ON s.symbol = e.symbol AND s.idx > e.idx AND s.idx <= e.idx + 48),
z AS (SELECT *, CASE WHEN is_long THEN greatest(close - risk, max(h) OVER w - 3 * atr) ELSE least(close + risk, min(l) OVER w + 3 * atr) END AS stp FROM y WINDOW w AS (PARTITION BY symbol, idx ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT symbol, idx, min(CASE WHEN (is_long AND l <= stp) OR (NOT is_long AND h >= stp) THEN j END) AS xj, max(j) AS lj, arg_max(jc, j) AS lc FROM z GROUP BY 1, 2),
o AS (SELECT e.*, xj, lj, lc, (SELECT stp FROM z WHERE z.symbol = e.symbol AND z.idx = e.idx AND z.j = xj) AS sp FROM ev e LEFT JOIN q USING (symbol, idx))
SELECT symbol, idx, coalesce(xj, lj, idx) AS exit_idx, CASE WHEN xj IS NOT NULL THEN 'trail' ELSE 'time' END AS reason, {sr('sg * (coalesce(sp, lc, close) - close) / risk - 2 * 0.0005 * close / risk')} AS net FROM o""")
def trailing_exit(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule())
    return O.trailing_exit(ev, T.bars(spark, d), 48, 3 * c("atr")).select("symbol", "idx", "exit_idx", "reason", r6("net").alias("net"))


@query("trade_excursions", "WITH " + FILL + f""", y AS (SELECT f.symbol, f.idx, s.idx AS j, s.h, s.l, is_long, fill, stop FROM f JOIN s ON s.symbol = f.symbol AND s.idx BETWEEN fill_idx AND fill_idx + 23),
cut AS (SELECT symbol, idx, min(CASE WHEN (is_long AND l <= stop) OR (NOT is_long AND h >= stop) THEN j END) AS cj FROM y GROUP BY 1, 2),
q AS (SELECT y.symbol, y.idx, greatest(max(CASE WHEN is_long THEN h - fill ELSE fill - l END), 0) AS fv, greatest(max(CASE WHEN is_long THEN fill - l ELSE h - fill END), 0) AS av FROM y JOIN cut USING (symbol, idx) WHERE cj IS NULL OR j < cj GROUP BY 1, 2)
SELECT f.symbol, f.idx, {sr('coalesce(fv, 0) / atr')} AS mfe_atr, {sr('coalesce(av, 0) / atr')} AS mae_atr, {sr('coalesce(fv, 0) / abs(fill - stop)')} AS mfe_r, {sr('coalesce(av, 0) / abs(fill - stop)')} AS mae_r FROM f LEFT JOIN q USING (symbol, idx)""")
def trade_excursions(spark, d):
    return rounded(O.excursions(fills(spark, d), T.bars(spark, d), ["symbol", "idx"], 24), ["symbol", "idx"], ["mfe_atr", "mae_atr", "mfe_r", "mae_r"])


_MM = "WITH " + EV + """, f AS (SELECT ev.*, s.idx AS ei, s.o AS ep, s.ts AS ets, s.o - ev.atr AS stp FROM ev JOIN s ON s.symbol = ev.symbol AND s.idx = ev.idx + 1 WHERE is_long),
y AS (SELECT f.symbol, f.idx, s.idx AS j, s.h, s.l, ep, stp FROM f JOIN s ON s.symbol = f.symbol AND s.idx BETWEEN ei AND ei + 11), k AS (SELECT symbol, idx, min(CASE WHEN l <= stp THEN j END) AS cj FROM y GROUP BY 1, 2),
q AS (SELECT y.symbol, y.idx, greatest(max(h - ep), 0) AS fv, greatest(max(ep - l), 0) AS av, count(*) AS nb, max(cj IS NOT NULL) AS hit FROM y JOIN k USING (symbol, idx) WHERE {keep} GROUP BY 1, 2)
SELECT f.symbol, f.ts AS signal_ts, ets AS entry_ts, ei AS entry_idx, ep AS entry_price, nb AS bars_measured, {m} hit AS sl_hit FROM f JOIN q USING (symbol, idx) {where}"""
_MCOLS = "".join(f"{sr(e)} AS {n}, " for n, e in (("mfe_abs", "fv"), ("mae_abs", "av"), ("mfe_atr", "fv / atr"), ("mae_atr", "av / atr"), ("mfe_r", "fv / atr"), ("mae_r", "av / atr")))
for _stop, _drop in ((False, False), (True, True)):
    @query("mfe_mae" + ("_stop_drop" if _stop else ""), _MM.format(keep="cj IS NULL OR j <= cj" if _stop else "true", m=_MCOLS, where="WHERE ei + 11 <= (SELECT max(idx) FROM s WHERE s.symbol = f.symbol)" if _drop else ""))
    def mfe_mae(spark, d, stop=_stop, drop=_drop):
        ev = G.entries(sig(spark, d), RB.cross_rule()).filter("is_long").select("symbol", "idx", "ts", "close", "atr")
        out = O.mfe_mae(ev, T.bars(spark, d), horizon=12, incomplete="drop" if drop else "partial", stop_exit=stop)
        keep = ["symbol", "signal_ts", "entry_ts", "entry_idx", "entry_price", "bars_measured", "sl_hit"]
        return rounded(out, keep, ["mfe_abs", "mae_abs", "mfe_atr", "mae_atr", "mfe_r", "mae_r"])


@query("mfe_quantiles", _MM.format(keep="true", m="fv / atr AS fa, av / atr AS aa, ", where="").replace("SELECT f.symbol, f.ts", "SELECT symbol, " + ", ".join(f"{sr(f'quantile_cont({x}, {q / 100})')} AS {n}_p{q}" for n, x in (("mfe", "fa"), ("mae", "aa")) for q in (50, 90)) + " FROM (SELECT f.symbol, f.ts") + ") GROUP BY symbol")
def mfe_quantiles(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule()).filter("is_long").select("symbol", "idx", "ts", "close", "atr")
    out = O.mfe_mae(ev, T.bars(spark, d), horizon=12)
    qs = F.array(F.lit(0.5), F.lit(0.9))
    g = out.groupBy("symbol").agg(F.percentile("mfe_atr", qs).alias("f"), F.percentile("mae_atr", qs).alias("a"))
    return g.select("symbol", r6(c("f")[0]).alias("mfe_p50"), r6(c("f")[1]).alias("mfe_p90"), r6(c("a")[0]).alias("mae_p50"), r6(c("a")[1]).alias("mae_p90"))


@query("limit_fill", "WITH " + EV + """, y AS (SELECT e.symbol, e.idx, min(CASE WHEN (is_long AND s.l <= e.close - 0.5 * e.atr - 0.1 * s.atr) OR (NOT is_long AND s.h >= e.close + 0.5 * e.atr + 0.1 * s.atr) THEN s.idx END) AS fill_idx FROM ev e
 LEFT JOIN s ON s.symbol = e.symbol AND s.idx > e.idx AND s.idx <= e.idx + 5 GROUP BY 1, 2) SELECT * FROM y""")
def limit_fill(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule()).select("symbol", "idx", "close", "atr", "is_long")
    level = c("close") - O.sign() * 0.5 * c("atr")
    return O.limit_fill(ev, sig(spark, d), ["symbol", "idx"], level).select("symbol", "idx", "fill_idx")


@query("barrier_labels", "WITH " + SIG + """, y AS (SELECT a.symbol, a.idx, a.nxt_o AS e, a.atr, z.idx - a.idx AS k, z.h, z.l FROM s a LEFT JOIN s z ON z.symbol = a.symbol AND z.idx > a.idx AND z.idx <= a.idx + 12),
q AS (SELECT symbol, idx, any_value(e) AS e, any_value(atr) AS atr, coalesce(min(CASE WHEN h >= e + 2 * atr THEN k END), 13) AS ut, coalesce(min(CASE WHEN l <= e - atr THEN k END), 13) AS us, coalesce(min(CASE WHEN l <= e - 2 * atr THEN k END), 13) AS dt, coalesce(min(CASE WHEN h >= e + atr THEN k END), 13) AS ds FROM y GROUP BY 1, 2)
SELECT symbol, idx, CASE WHEN e IS NOT NULL AND atr IS NOT NULL THEN (ut < us)::INT END AS long_label, CASE WHEN e IS NOT NULL AND atr IS NOT NULL THEN (dt < ds)::INT END AS short_label FROM q""")
def barrier_labels(spark, d):
    f = Frame.of_numbered(sig(spark, d).select("symbol", "idx", "open", "high", "low", "close", "atr"), 0, 13)
    return O.barrier_labels(f, 2.0, 1.0, 12).core("symbol", "idx", "long_label", "short_label")


@query("direction_labels", Sql().add(y=f"lead(c, 24) OVER {ORD} / c - 1").text(f"SELECT symbol, idx, {sr('y')} AS fwd_ret, CASE WHEN y > 0.02 THEN 1 WHEN y < -0.02 THEN -1 WHEN y IS NOT NULL THEN 0 END AS label FROM $"))
def direction_labels(spark, d):
    f = O.direction_labels(Frame.of_numbered(T.bars(spark, d), 0, 24))
    return f.core("symbol", "idx", r6("fwd_ret").alias("fwd_ret"), "label")


@query("atr_levels", Sql().add(p=f"coalesce({lag('c')}, c)").add(tr="greatest(h - l, abs(h - p), abs(l - p))").add(a=f"CASE WHEN avg(tr) OVER {win(14)} <= 0 THEN 1e-6 ELSE avg(tr) OVER {win(14)} END").add(pa=f"coalesce({lag('a')}, a)").add(
    tp="c + 2 * pa", sl="greatest(c - 1.5 * pa, 1e-6)").out("tp", "sl", digits=5))
def atr_levels(spark, d):
    f = research_atr(Frame.of_numbered(T.bars(spark, d), 16), "atr")
    return rounded(O.atr_levels(f).core(), ["symbol", "idx"], ["tp", "sl"], 5)


@query("gap_through_stop", "WITH " + TR + f""", y AS (SELECT tr.symbol, s.o, is_long, close - sg * risk AS stop, risk FROM tr JOIN s ON s.symbol = tr.symbol AND s.idx = tr.exit_idx WHERE reason = 'sl')
SELECT symbol, count(*) AS stops, count_if((is_long AND o < stop) OR (NOT is_long AND o > stop))::BIGINT AS gapped, {sr('max(CASE WHEN (is_long AND o < stop) OR (NOT is_long AND o > stop) THEN abs(o - stop) / risk END)')} AS worst_r FROM y GROUP BY 1""")
def gap_through_stop(spark, d):
    return rounded(O.gap_through_stop(trades(spark, d), T.bars(spark, d)), ["symbol", "stops", "gapped"], ["worst_r"])


@query("stop_target_grid", "WITH " + EV + """, r AS (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS k), t AS (SELECT unnest([2.0, 3.0])::DOUBLE AS goal), y AS (SELECT ev.symbol, ev.idx, close, atr * k AS risk, k, goal, sg, is_long FROM ev, r, t),
p AS (SELECT y.symbol, y.idx, k, goal, s.idx AS j, s.c AS jc, CASE WHEN (is_long AND s.l <= close - risk) OR (NOT is_long AND s.h >= close + risk) THEN 0 WHEN (is_long AND s.h >= close + goal * risk) OR (NOT is_long AND s.l <= close - goal * risk) THEN 1 END AS kind
 FROM y JOIN s ON s.symbol = y.symbol AND s.idx > y.idx AND s.idx <= y.idx + 24), q AS (SELECT symbol, idx, k, goal, min(CASE WHEN kind IS NOT NULL THEN j * 2 + kind END) AS code, arg_max(jc, j) AS lc FROM p GROUP BY ALL)
SELECT k, goal, count(*) AS n, """ + sr("avg(CASE WHEN code % 2 = 0 THEN -1 WHEN code % 2 = 1 THEN goal ELSE sg * (coalesce(lc, close) - close) / risk END)") + " AS ev FROM y LEFT JOIN q USING (symbol, idx, k, goal) GROUP BY 1, 2")
def stop_target_grid(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule()).select("symbol", "idx", "close", "atr", "is_long")
    grid = ev.withColumn("k", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))).withColumn("goal", F.explode(F.array(F.lit(2.0), F.lit(3.0))))
    out = O.r_exit(grid.withColumn("risk", c("atr") * c("k")), T.bars(spark, d), ["symbol", "idx", "k", "goal"], c("goal"), 24)
    return rounded(out.groupBy("k", "goal").agg(F.count(F.lit(1)).alias("n"), F.avg("gross").alias("ev")), ["k", "goal", "n"], ["ev"])


# -- portfolio --------------------------------------------------------------
@query("vol_target_size", Sql().add(lr=f"ln(c / {lag('c')})").add(v0=f"stddev_pop(lr) OVER {win(50, 1)} * sqrt(2190)").add(
    size="CASE WHEN v0 > 0 THEN greatest(0.25, least(2, 2.0 / v0)) ELSE 1 END").out("size"))
def vol_target_size(spark, d):
    f = P.vol_target_size(Frame.of_numbered(T.bars(spark, d), 52), 50, 2.0)
    return rounded(f.core(), ["symbol", "idx"], ["size"])


@query("regime_size", Sql().add(p=f"coalesce({lag('c')}, c)").add(tr="greatest(h - l, abs(h - p), abs(l - p))").add(w=f"list(tr) OVER {win(50)}").add(
    pct="100.0 * len(list_filter(w, lambda x: x <= tr)) / len(w)").text("SELECT symbol, idx, CASE WHEN pct > 90 THEN 0.25 WHEN pct > 80 THEN 0.5 ELSE 1 END::DOUBLE AS size FROM $"))
def regime_size(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 52)
    prev = F.coalesce(f.lag(c("close")), c("close"))
    f = f.add(tr=F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)))
    f = f.add(pct=100 * R.percent_rank(f, "tr", 50))
    return f.core("symbol", "idx", P.regime_size(c("pct")).alias("size"))


@query("accrual_stream", "WITH " + STREAM + f"SELECT idx, {sr('r')} AS r, n_open FROM st")
def accrual_stream(spark, d):
    return stream(spark, d).select("idx", r6("r").alias("r"), "n_open")


@query("asset_bar_matrix", "WITH " + BOOK + f"SELECT symbol, i.idx, {sr('sum(net / (greatest(e1 - e0, 1) + 1))')} AS r FROM bk JOIN (SELECT unnest(range(0, 2000)) AS idx) i ON i.idx BETWEEN e0 AND e1 GROUP BY 1, 2")
def asset_bar_matrix(spark, d):
    return rounded(P.accrual_direct(book(spark, d), ["symbol"]), ["symbol", "idx"], ["r"])


@query("daily_rollup", "WITH " + STREAM + f"SELECT idx // 24 AS day, {sr('sum(r)')} AS r, {sr('arg_max(r, idx)')} AS last_r FROM st GROUP BY 1")
def daily_rollup(spark, d):
    return rounded(P.rollup(stream(spark, d), 24), ["day"], ["r", "last_r"])


@query("concurrency", "WITH " + STREAM + "SELECT quantile_cont(n_open, 0.5) AS conc_p50, quantile_cont(n_open, 0.95) AS conc_p95, max(n_open)::DOUBLE AS conc_max, " + sr("avg((n_open >= 5)::INT)") + " AS pct_ge5 FROM st")
def concurrency(spark, d):
    return P.concurrency_stats(stream(spark, d)).select("conc_p50", "conc_p95", "conc_max", r6("pct_ge5").alias("pct_ge5"))


_LAGS = "WITH " + STREAM + ", k AS (SELECT unnest(range(1, 41)) AS k), rho AS (SELECT k, count(*) AS n, corr(a.r, z.r) AS rho FROM k JOIN st a ON true JOIN st z ON z.idx = a.idx + k GROUP BY k)"


@query("lag_correlations", _LAGS + f"SELECT k::INTEGER AS k, n, {sr('rho')} AS rho FROM rho")
def lag_correlations(spark, d):
    return P.lag_correlations(stream(spark, d), 40).select("k", c("n").cast("long").alias("n"), r6("rho").alias("rho"))


@query("nw_sharpe", _LAGS + f", m AS (SELECT count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd FROM st) SELECT n, {sr('mean / sd * sqrt(8760) / sqrt(greatest(1e-6, 1 + 2 * (SELECT sum(rho) FROM rho)))')} AS sharpe_nw FROM m")
def nw_sharpe(spark, d):
    return rounded(P.nw_sharpe(stream(spark, d), 40, 8760), ["n"], ["sharpe_nw"])


@query("nw_sharpe_clamped", _LAGS + f", m AS (SELECT count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd FROM st) SELECT n, {sr('mean / sd * sqrt(8760) / sqrt(greatest(1, least(5, 1 + 2 * (SELECT sum(rho) FROM rho WHERE k <= 5))))')} AS sharpe_nw FROM m")
def nw_sharpe_clamped(spark, d):
    return rounded(P.nw_sharpe(stream(spark, d), 5, 8760, clamp=(1.0, 5.0)), ["n"], ["sharpe_nw"])


_DD = "WITH " + STREAM + ", q AS (SELECT idx, r, sum(ln(1 + 0.01 * r)) OVER (ORDER BY idx) AS s, sum(r) OVER (ORDER BY idx) AS a FROM st), p AS (SELECT *, max(s) OVER (ORDER BY idx) AS ps, max(a) OVER (ORDER BY idx) AS pa FROM q)"


@query("max_drawdown", _DD + f"SELECT {sr('max(1 - exp(s - ps))')} AS dd FROM p")
def max_drawdown(spark, d):
    return P.drawdown(stream(spark, d)).select(r6("dd").alias("dd"))


@query("max_drawdown_r", _DD + f"SELECT {sr('max(pa - a)')} AS max_dd_r FROM p")
def max_drawdown_r(spark, d):
    return P.drawdown_r(stream(spark, d)).select(r6("max_dd_r").alias("max_dd_r"))


@query("drawdown_episodes", _DD + f""", w AS (SELECT *, sum((a >= pa)::INT) OVER (ORDER BY idx) AS grp, CASE WHEN a >= pa THEN idx END AS pk FROM p), e AS (SELECT grp, max(pk) AS peak_idx, min(CASE WHEN a < pa THEN idx END) AS start_idx, max(CASE WHEN a < pa THEN idx END) AS end_idx, max(pa - a) AS depth FROM w GROUP BY grp)
SELECT peak_idx, start_idx, end_idx, {sr('depth')} AS depth FROM e WHERE start_idx IS NOT NULL ORDER BY e.depth DESC LIMIT 5""")
def drawdown_episodes(spark, d):
    return P.drawdown_episodes(stream(spark, d), 5).select("peak_idx", "start_idx", "end_idx", r6("depth").alias("depth"))


@query("trade_statistics", "WITH " + BOOK + f"""SELECT symbol, count(*) AS n, {sr('avg(net)')} AS ev, {sr('avg(net) / stddev_samp(net) * sqrt(count(*))')} AS t_stat, {sr('sum(CASE WHEN net > 0 THEN net ELSE 0 END) / sum(CASE WHEN net < 0 THEN -net ELSE 0 END)')} AS profit_factor,
 {sr('avg((net > 0)::INT)')} AS win_rate, {sr('avg(net) / stddev_samp(net)')} AS sharpe_per_trade FROM bk GROUP BY 1""")
def trade_statistics(spark, d):
    return rounded(P.trade_stats(book(spark, d), ["symbol"]), ["symbol", "n"], ["ev", "t_stat", "profit_factor", "win_rate", "sharpe_per_trade"])


@query("bucketed_sharpe", "WITH " + BOOK + f""", f AS (SELECT symbol, min(ts) AS t0 FROM bk GROUP BY 1), q AS (SELECT symbol, (ts - t0) // 259200000 AS w, sum(net) AS s FROM bk JOIN f USING (symbol) GROUP BY 1, 2),
gg AS (SELECT symbol, unnest(range(0, max(w) + 1)) AS w FROM q GROUP BY 1), z AS (SELECT symbol, coalesce(s, 0) AS s FROM gg LEFT JOIN q USING (symbol, w)) SELECT symbol, {sr('avg(s) / stddev_samp(s) * sqrt(365.25 / 3)')} AS sharpe_ann FROM z GROUP BY 1""")
def bucketed_sharpe(spark, d):
    return rounded(P.bucketed_sharpe(book(spark, d), ["symbol"], days=3), ["symbol"], ["sharpe_ann"])


def hash_sql(*parts: str) -> str:
    x = "0::BIGINT"
    for p in parts:
        x = f"((({x}) + ({p}) + 1) * 48271) % 2147483647"
        x = f"(({x}) * 69621 + 12345) % 2147483647"
    return f"(({x}))"


@query("block_bootstrap", "WITH " + STREAM + f""", n AS (SELECT count(*)::BIGINT AS n FROM st), pl AS (SELECT rep, j, n, ({hash_sql('11', 'rep', 'j')} % n) AS a, least(60, n - j * 60) AS len FROM n, (SELECT unnest(range(0, 100))::BIGINT AS rep) q, (SELECT unnest(range(0, 2000))::BIGINT AS j) z WHERE j < ceil(n / 60.0)),
ps AS (SELECT idx, sum(r) OVER (ORDER BY idx) AS s FROM st), m AS (SELECT rep, sum(coalesce((SELECT s FROM ps WHERE ps.idx = CASE WHEN a + len > n THEN a + len - n ELSE a + len END - 1), 0) + CASE WHEN a + len > n THEN (SELECT max_by(s, idx) FROM ps) ELSE 0 END - coalesce((SELECT s FROM ps WHERE ps.idx = a - 1), 0)) / any_value(n) AS m FROM pl GROUP BY rep)
SELECT {sr('quantile_cont(m, 0.025)', 8)} AS ci_lo, {sr('quantile_cont(m, 0.975)', 8)} AS ci_hi FROM m""")
def block_bootstrap(spark, d):
    return P.block_bootstrap(stream(spark, d), 60, 100).select(r6("ci_lo", 8).alias("ci_lo"), r6("ci_hi", 8).alias("ci_hi"))


@query("paired_bootstrap", "WITH " + BOOK + f""", w AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS idx, gross - net AS d, net FROM bk), n AS (SELECT symbol, count(*) AS n, avg(net - d) AS diff FROM w GROUP BY 1),
dr AS (SELECT w.symbol, rep, ({hash_sql('7', 'rep', 'w.idx')} % n) AS pick FROM w JOIN n USING (symbol), (SELECT unnest(range(0, 50))::BIGINT AS rep) q), m AS (SELECT dr.symbol, rep, avg(w.net - w.d) AS m FROM dr JOIN w ON w.symbol = dr.symbol AND w.idx = dr.pick GROUP BY 1, 2)
SELECT m.symbol AS book, any_value(n) AS n, {sr('any_value(diff)')} AS diff, {sr('quantile_cont(m, 0.025)')} AS lo, {sr('quantile_cont(m, 0.975)')} AS hi, {sr('avg((m <= 0)::INT)')} AS p_le0 FROM m JOIN n USING (symbol) GROUP BY 1""")
def paired_bootstrap(spark, d):
    t = number_bars(book(spark, d).drop("idx", "book").withColumnRenamed("symbol", "book"), HOUR_MS, key="book", ts="ts")
    pairs = t.select("book", "idx", c("net").alias("a"), c("fee").alias("b"))
    return rounded(P.paired_bootstrap(pairs, 50), ["book", "n"], ["diff", "lo", "hi", "p_le0"])


@query("nw_z", _LAGS + f", m AS (SELECT count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd FROM st) SELECT n, {sr('mean / (sd / sqrt(n / greatest(1, 1 + 2 * (SELECT sum(rho) FROM rho))))')} AS z FROM m")
def nw_z(spark, d):
    return rounded(IN.nw_z(stream(spark, d), 40), ["n"], ["z"])


@query("nw_covariance_sharpe", "WITH " + STREAM + f""", m AS (SELECT count(*) AS n, avg(r) AS mean, var_pop(r) AS v0 FROM st), cv AS (SELECT k, sum((a.r - mean) * (z.r - mean)) / any_value(n) AS cov FROM (SELECT unnest(range(1, 200)) AS k) q JOIN st a ON true JOIN st z ON z.idx = a.idx + k, m WHERE k < least(200, n - 1) GROUP BY k),
en AS (SELECT coalesce(min(k), 1000) AS e FROM cv, m WHERE abs(cov) < 0.01 * v0), us AS (SELECT coalesce(sum(cov), 0) AS s, count(*) AS used FROM cv, en WHERE k < e) SELECT n, used, {sr('mean * 8760 / sqrt(greatest(v0 + 2 * s, 1e-18) * 8760)')} AS sharpe_nw FROM m, us""")
def nw_covariance_sharpe(spark, d):
    return rounded(IN.nw_covariance_sharpe(stream(spark, d), 200, 8760), ["n", "used"], ["sharpe_nw"])


@query("poisson_bootstrap", "WITH " + BOOK + f""", w AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS idx, net - (gross - net) AS d FROM bk), u AS (SELECT symbol, rep, d, {hash_sql('7', 'rep', 'w.idx')} AS u FROM w, (SELECT unnest(range(0, 50))::BIGINT AS rep) q),
k AS (SELECT symbol, rep, d, {' + '.join(f'(u >= {t})::INT' for t in IN.POISSON)} AS k FROM u), m AS (SELECT symbol, rep, sum(k * d) / nullif(sum(k), 0) AS m FROM k GROUP BY 1, 2), n AS (SELECT symbol, count(*) AS n, avg(d) AS diff FROM w GROUP BY 1)
SELECT symbol AS book, any_value(n) AS n, {sr('any_value(diff)')} AS diff, {sr('quantile_cont(m, 0.025)')} AS lo, {sr('quantile_cont(m, 0.975)')} AS hi, {sr('avg((m <= 0)::INT)')} AS p_le0 FROM m JOIN n USING (symbol) GROUP BY 1""")
def poisson_bootstrap(spark, d):
    t = number_bars(book(spark, d).drop("idx", "book").withColumnRenamed("symbol", "book"), HOUR_MS, key="book", ts="ts")
    return rounded(IN.poisson_bootstrap(t.select("book", "idx", c("net").alias("a"), c("fee").alias("b")), 50), ["book", "n"], ["diff", "lo", "hi", "p_le0"])


@query("effective_bets", "WITH " + BOOK + f""", x AS (SELECT symbol, i.idx, sum(net / (greatest(e1 - e0, 1) + 1)) AS r FROM bk JOIN (SELECT unnest(range(0, 2000)) AS idx) i ON i.idx BETWEEN e0 AND e1 GROUP BY 1, 2), act AS (SELECT idx FROM x GROUP BY idx HAVING sum(r) <> 0),
gg AS (SELECT a.idx, q.symbol, coalesce(x.r, 0) AS r FROM act a CROSS JOIN (SELECT DISTINCT symbol FROM x) q LEFT JOIN x ON x.idx = a.idx AND x.symbol = q.symbol), rho AS (SELECT a.symbol AS a, z.symbol AS z, corr(a.r, z.r) AS rho FROM gg a JOIN gg z USING (idx) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM act) AS n_active, {sr('count(DISTINCT a) * count(DISTINCT a) / sum(rho * rho)')} AS enb FROM rho""")
def effective_bets(spark, d):
    return rounded(P.enb(P.accrual_direct(book(spark, d), ["symbol"])), ["n_active"], ["enb"])


@query("orthogonal_ev", "WITH " + BOOK + f""", q AS (SELECT is_long, net, ln(close / risk) AS f FROM bk), k AS (SELECT is_long, covar_samp(net, f) / var_pop(f) AS b, count(*) AS n FROM q GROUP BY 1), e AS (SELECT q.is_long, net - b * f AS e, n FROM q JOIN k USING (is_long))
SELECT is_long, any_value(n) AS n, {sr('avg(e)')} AS ev_orth, {sr('avg(e) / stddev_pop(e) * sqrt(any_value(n))')} AS t_orth FROM e GROUP BY 1""")
def orthogonal_ev(spark, d):
    t = book(spark, d).withColumn("f", F.log(c("close") / c("risk")))
    return rounded(P.ortho_ev(t, ["is_long"]), ["is_long", "n"], ["ev_orth", "t_orth"])


@query("leg_breakdown", "WITH " + BOOK + f""", q AS (SELECT *, row_number() OVER (PARTITION BY is_long ORDER BY net DESC) AS k FROM bk) SELECT is_long, count(*) AS n, {sr('avg(net)')} AS ev, {sr('avg(e1 - e0)')} AS avg_hold,
 {sr('avg(CASE WHEN k > 20 THEN net END)')} AS ex_top_ev, {sr('sum(CASE WHEN k <= 20 THEN net END) / sum(net)')} AS top_share FROM q GROUP BY 1""")
def leg_breakdown(spark, d):
    return rounded(P.leg_breakdown(book(spark, d), ["is_long"]), ["is_long", "n"], ["ev", "avg_hold", "ex_top_ev", "top_share"])


@query("reason_breakdown", "WITH " + BOOK + f"SELECT reason, is_long, count(*) AS n, {sr('sum(net)')} AS total FROM bk GROUP BY 1, 2")
def reason_breakdown(spark, d):
    return rounded(book(spark, d).groupBy("reason", "is_long").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("total")), ["reason", "is_long", "n"], ["total"])


@query("yearly_breakdown", f"SELECT year(l_shipdate)::INTEGER AS year, count(*) AS n, {sr('avg(l_discount)')} AS ev FROM lineitem GROUP BY 1")
def yearly_breakdown(spark, d):
    return rounded(T.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("ev")), ["year", "n"], ["ev"])


@query("null_model_entries", "WITH " + EV + f""", e AS (SELECT symbol, count(*) AS k FROM ev GROUP BY 1), r AS (SELECT rep, s.symbol, s.idx, row_number() OVER (PARTITION BY rep, s.symbol ORDER BY {hash_sql('3', 'rep', 's.idx')}, s.idx) AS o FROM s, (SELECT unnest(range(0, 20))::BIGINT AS rep) q WHERE s.idx >= 30),
p AS (SELECT r.rep, r.symbol, r.idx FROM r JOIN e USING (symbol) WHERE o <= k) SELECT p.rep, p.symbol, count(*) AS n, {sr('avg(a.c - z.c)')} AS drift FROM p JOIN s z USING (symbol, idx) JOIN s a ON a.symbol = p.symbol AND a.idx = least(p.idx + 6, z.last_idx) GROUP BY 1, 2""")
def null_model_entries(spark, d):
    from pyspark.sql import Window

    s = sig(spark, d).select("symbol", "idx", "close")
    n = G.entries(sig(spark, d), RB.cross_rule()).groupBy("symbol").agg(F.count(F.lit(1)).alias("k"))
    last = s.groupBy("symbol").agg(F.max("idx").alias("_last"))
    # the k smallest hashes per replicate: found per block of bars first, then among the survivors
    rows = s.filter("idx >= 30").join(n, "symbol").join(last, "symbol").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    rows = rows.withColumns({"h": P.hashed(F.lit(3), c("rep"), c("idx")), "blk": F.floor(c("idx") / 256)})
    for part in (["rep", "symbol", "blk"], ["rep", "symbol"]):
        rows = rows.withColumn("o", F.row_number().over(Window.partitionBy(*part).orderBy("h", "idx"))).filter("o <= k")
    later = s.select("symbol", c("idx").alias("_j"), c("close").alias("_c"))
    hit = rows.withColumn("_j", F.least(c("idx") + 6, c("_last"))).join(later, ["symbol", "_j"])
    out = hit.groupBy(c("rep").cast("long").alias("rep"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(c("_c") - c("close")).alias("drift"))
    return rounded(out, ["rep", "symbol", "n"], ["drift"])


_SM = "WITH RECURSIVE " + BOOK + """, w AS MATERIALIZED (SELECT symbol, idx AS decision, exit_idx AS x, sg, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS k FROM bk),
m AS (SELECT symbol, k, 'taken' AS status, x AS busy, sg AS side FROM w WHERE k = 0 UNION ALL
 SELECT n.symbol, n.k, CASE WHEN n.decision = p.busy THEN 'same_bar_after_exit' WHEN n.decision < p.busy THEN 'in_position' WHEN n.decision < p.busy + 3 THEN 'cooldown' ELSE 'taken' END,
 CASE WHEN n.decision <> p.busy AND n.decision > p.busy AND n.decision >= p.busy + 3 THEN n.x ELSE p.busy END, n.sg FROM m p JOIN w n ON n.symbol = p.symbol AND n.k = p.k + 1) """


def _signals(spark, d):
    b = book(spark, d).select("symbol", "ts", c("idx").alias("decision"), c("exit_idx").alias("exit"), O.sign().alias("side"), "net")
    return number_bars(b, HOUR_MS)


@query("position_state_machine", _SM + "SELECT w.symbol, w.decision, m.status FROM m JOIN w USING (symbol, k)")
def position_state_machine(spark, d):
    return P.state_machine(_signals(spark, d), cooldown=3).select("symbol", "decision", "status")


@query("admitted_trades", _SM + f"SELECT w.symbol, count(*) AS n, {sr('sum(bk.net)')} AS total FROM m JOIN w USING (symbol, k) JOIN bk ON bk.symbol = w.symbol AND bk.idx = w.decision WHERE status = 'taken' GROUP BY 1")
def admitted_trades(spark, d):
    ok = P.state_machine(_signals(spark, d), cooldown=3).filter("status = 'taken'").select("symbol", c("decision").alias("idx"))
    kept = book(spark, d).join(ok, ["symbol", "idx"], "left_semi")
    return rounded(kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("total")), ["symbol", "n"], ["total"])


def _queue(spark, d):
    b = book(spark, d).select("book", "symbol", c("e0").alias("entry"), c("e1").alias("exit"), (-c("risk")).alias("score"), "net")
    return number_bars(b, 8, key="book", ts="entry", ties=("symbol",))


for _replace in (False, True):
    query("slot_admission" + ("_replace" if _replace else ""))(
        lambda spark, d, rep=_replace: P.admit_slots(_queue(spark, d), 2, rep).select("idx", "entry", "exit", "taken", "replaces"))


@query("drawdown_brake", "WITH RECURSIVE " + STREAM + f""", k AS (SELECT -1::BIGINT AS idx, 0.0::DOUBLE AS eq, 0.0::DOUBLE AS peak, -1::BIGINT AS til, true AS active, 0.0::DOUBLE AS used
 UNION ALL SELECT idx, eq2, CASE WHEN hit THEN eq2 ELSE pk2 END, CASE WHEN hit THEN idx + 1 + 48 ELSE til END, on1, g FROM (SELECT *, on1 AND pk2 - eq2 >= 3 AS hit FROM (SELECT *, greatest(peak, eq2) AS pk2 FROM (SELECT n.idx, p.til, p.peak, n.idx >= p.til AS on1, CASE WHEN n.idx >= p.til THEN n.r ELSE 0 END AS g, p.eq + CASE WHEN n.idx >= p.til THEN n.r ELSE 0 END AS eq2 FROM k p JOIN st n ON n.idx = p.idx + 1))))
SELECT idx, active, {sr('used')} AS r_used FROM k WHERE idx >= 0""")
def drawdown_brake(spark, d):
    return P.drawdown_brake(stream(spark, d), 3.0, 48).select("idx", "active", r6("r_used").alias("r_used"))


@query("parity_check", "WITH " + TR + "SELECT count(*)::BIGINT AS missing, 0::BIGINT AS extra FROM tr WHERE idx % 50 = 0")
def parity_check(spark, d):
    again = RB.trades_of(RB.average_cross(T.bars(spark, d)), T.bars(spark, d), RB.cross_rule()).select("symbol", "idx", "exit_idx")
    recorded = trades(spark, d).filter("idx % 50 != 0").select("symbol", "idx", "exit_idx")
    missing = again.join(recorded, again.columns, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return missing.crossJoin(recorded.join(again, again.columns, "left_anti").agg(F.count(F.lit(1)).alias("extra")))


@query("gate_battery", "WITH " + BOOK + f""", q AS (SELECT symbol, count(*) AS n, avg(net) AS ev, avg((net > 0)::INT) AS wr FROM bk GROUP BY 1) SELECT symbol, n, coalesce(ev >= 0.0, false) AS gate_ev, coalesce(wr <= 0.5, false) AS gate_win_rate, CASE WHEN ev >= 0 AND wr <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM q""")
def gate_battery(spark, d):
    m = P.trade_stats(book(spark, d), ["symbol"])
    return P.gates(m, {"ev": (">=", 0.0), "win_rate": ("<=", 0.5)}).select("symbol", "n", "gate_ev", "gate_win_rate", "verdict")


@query("rule_pipeline")
def rule_pipeline(spark, d):
    """Signals to verdict for both segments; the interval uses hashed draws."""
    t, st = RB.segments(book(spark, d), stream(spark, d), grid_size(spark, d).select("n"))
    m = RB.metrics(t, settled(st))
    return P.gates(m, {"sharpe_nw": (">=", 1.0), "dd": ("<=", 0.25), "ev": (">=", 0.1), "pos_assets": (">=", 3), "ci_lo": (">=", 0.0)})


@query("segment_metrics", "WITH " + STREAM + f""", ct AS (SELECT floor(max(n) * 2 / 3)::BIGINT AS cut FROM bk), sg AS (SELECT CASE WHEN idx >= cut THEN 'F3' ELSE 'PRIMARY' END AS book, idx, r FROM st, ct), q AS (SELECT *, sum(ln(1 + 0.01 * r)) OVER (PARTITION BY book ORDER BY idx) AS s FROM sg),
p AS (SELECT *, max(s) OVER (PARTITION BY book ORDER BY idx) AS ps FROM q), dd AS (SELECT book, max(1 - exp(s - ps)) AS dd FROM p GROUP BY 1), tr2 AS (SELECT CASE WHEN e0 >= cut THEN 'F3' ELSE 'PRIMARY' END AS book, net FROM bk, ct)
SELECT book, count(*) AS n_trades, {sr('avg(net)')} AS ev, {sr('any_value(dd)')} AS dd FROM tr2 JOIN dd USING (book) GROUP BY 1""")
def segment_metrics(spark, d):
    t, st = RB.segments(book(spark, d), stream(spark, d), grid_size(spark, d).select("n"))
    m = P.trade_stats(t, ["book"]).join(P.drawdown(settled(st)), "book")
    return m.select("book", c("n").alias("n_trades"), r6("ev").alias("ev"), r6("dd").alias("dd"))


@query("exposure_hedge", "WITH " + STREAM + f""", e AS (SELECT i.idx, sum(sg) AS expo FROM (SELECT unnest(range(0, (SELECT max(n) FROM bk))) AS idx) i JOIN bk ON i.idx BETWEEN e0 AND e1 GROUP BY 1), g0 AS (SELECT min(ts) AS g0 FROM s),
f AS (SELECT (ts - g0) // 3600000 AS idx, ln(c / lag(c) OVER (ORDER BY ts)) AS f FROM s, g0 WHERE symbol = 'click'), a AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS alpha)
SELECT alpha, {sr('sum(r - alpha * 0.01 * coalesce(expo, 0) * coalesce(f, 0))')} AS total FROM st LEFT JOIN e USING (idx) LEFT JOIN f USING (idx), a GROUP BY alpha""")
def exposure_hedge(spark, d):
    """Signed open size per bar; stream minus alpha times exposure times the benchmark return."""
    expo = P.accrual(book(spark, d).withColumns({"net": O.sign() * (F.greatest(c("e1") - c("e0"), F.lit(1)) + 1)}), grid_size(spark, d)).select("idx", c("r").alias("expo"))
    b = T.bars(spark, d)
    g0 = b.agg(F.min("ts").alias("_g"))
    f = Frame.of_numbered(b.filter("symbol = 'click'"), 1)
    f = f.add(f=F.log(c("close") / f.lag(c("close")))).core().crossJoin(F.broadcast(g0)).select(((c("ts") - c("_g")) / HOUR_MS).cast("long").alias("idx"), "f")
    j = stream(spark, d).join(expo, "idx", "left").join(f, "idx", "left").withColumn("alpha", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    total = F.sum(c("r") - c("alpha") * 0.01 * F.coalesce("expo", F.lit(0.0)) * F.coalesce("f", F.lit(0.0)))
    return rounded(j.groupBy("alpha").agg(total.alias("total")), ["alpha"], ["total"])


@query("weighted_streams", "WITH " + STREAM + f", z AS (SELECT idx, r, lag(r, 24) OVER (ORDER BY idx) AS q FROM st) SELECT idx, {sr('0.5 * (r + coalesce(q, 0))')} AS r FROM z")
def weighted_streams(spark, d):
    a = stream(spark, d).select("idx", "r")
    z = a.select((c("idx") + 24).alias("idx"), c("r").alias("q"))
    return a.join(z, "idx", "left").select("idx", r6(0.5 * (c("r") + F.coalesce("q", F.lit(0.0)))).alias("r"))


@query("position_stream", Sql().add(z=f"(c - {avg('c', 20)}) / nullif({full('stddev_pop(c)', 'c', 20)}, 0)").add(ev="CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 WHEN abs(z) < 0.1 THEN 0 END").add(
    pos=f"coalesce(last_value(ev IGNORE NULLS) OVER {ORD}, 0)").add(pp=f"coalesce({lag('pos')}, 0)", ret=f"c / {lag('c')} - 1").text(
    f"SELECT symbol, idx, pos::INTEGER AS pos, {sr('coalesce(pp * ret, 0) - 0.001 * abs(pos - pp)')} AS r FROM $"))
def position_stream(spark, d):
    """Mean-reversion position held by hysteresis, lagged one bar, charged for turnover."""
    from ..plans.crosssection import hysteresis

    f = Frame.of_numbered(T.bars(spark, d), 24)
    f = f.add(z=R.ratio(c("close") - R.mean(f, "close", 20), R.std(f, "close", 20, 0)))
    f = hysteresis(f, "pos", c("z") <= -1, F.abs("z") < 0.1, c("z") >= 1, F.lit(False))
    f = f.add(_pp=F.coalesce(f.lag(c("pos")), F.lit(0)), _ret=c("close") / f.lag(c("close")) - 1)
    return f.core("symbol", "idx", "pos", r6(F.coalesce(c("_pp") * c("_ret"), F.lit(0.0)) - 0.001 * F.abs(c("pos") - c("_pp"))).alias("r"))
