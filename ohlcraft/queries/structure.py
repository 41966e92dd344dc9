"""Pivots, order blocks, zones and entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import avs as C
from ..functions.volatility import research_atr
from ..operators.frames import DAY_MS, HOUR_MS, Frame, number_bars
from ..operators.resample import resample
from ..plans import structure as S
from ..sources import tables as T
from ..sources.store import stored
from .base import ORD, Sql, avg, bars_sql, lag, mn, mx, query, r6, rounded, sr, win
from .volatility import _CH1, _CH2, tr_sql

c = F.col

# -- pivots -----------------------------------------------------------------
_Z = f"""b AS MATERIALIZED ({bars_sql()}), z AS (
 SELECT symbol, -1::BIGINT AS idx, 0 AS way, -1::BIGINT AS li, -1e18 AS lv, -1::BIGINT AS ai, 1e18 AS av, -1::BIGINT AS pi, NULL::DOUBLE AS pp, 0 AS pk FROM b WHERE idx = 0
 UNION ALL
 SELECT symbol, idx, CASE WHEN hit <> 0 THEN -hit ELSE way END, CASE WHEN hit <> 0 THEN idx ELSE li2 END, CASE WHEN hit = 1 THEN l WHEN hit = -1 THEN h ELSE lv2 END,
  ai2, av2, CASE WHEN hit = 1 THEN li2 WHEN hit = -1 AND way = 0 THEN ai2 WHEN hit = -1 THEN li2 ELSE -1 END, CASE WHEN hit = 1 THEN lv2 WHEN hit = -1 AND way = 0 THEN av2 WHEN hit = -1 THEN lv2 END, hit
 FROM (SELECT *, CASE WHEN way = 0 AND lv2 - l >= 80 THEN 1 WHEN way = 0 AND h - av2 >= 80 THEN -1 WHEN way = 1 AND NOT moved AND lv2 - l >= 80 THEN 1 WHEN way = -1 AND NOT moved AND h - lv2 >= 80 THEN -1 ELSE 0 END AS hit
  FROM (SELECT n.symbol, n.idx, n.h, n.l, p.way, (p.way = 1 AND n.h > p.lv) OR (p.way = -1 AND n.l < p.lv) AS moved,
    CASE WHEN (p.way >= 0 AND n.h > p.lv) OR (p.way = -1 AND n.l < p.lv) THEN n.idx ELSE p.li END AS li2, CASE WHEN p.way >= 0 THEN greatest(n.h, p.lv) ELSE least(n.l, p.lv) END AS lv2,
    CASE WHEN p.way = 0 AND n.l < p.av THEN n.idx ELSE p.ai END AS ai2, CASE WHEN p.way = 0 THEN least(n.l, p.av) ELSE p.av END AS av2
   FROM z p JOIN b n ON n.symbol = p.symbol AND n.idx = p.idx + 1))),
pv AS MATERIALIZED (SELECT symbol, pi AS idx, pp AS price, pk AS kind, idx AS confirm_idx, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS n FROM z WHERE pk <> 0)"""


@query("zigzag_pivots", f"WITH RECURSIVE {_Z} SELECT symbol, idx, price, kind::BIGINT AS kind, confirm_idx, n FROM pv")
def zigzag_pivots(spark, d):
    return S.pivots(T.bars(spark, d), 80.0).select("symbol", "idx", "price", "kind", "confirm_idx", "n")


_LAB = _Z + """, q AS (SELECT *, lead(idx) OVER w AS next_idx, lead(confirm_idx) OVER w AS next_confirm, lag(price, 1) OVER w AS p1, lag(price, 2) OVER w AS p2, lag(price, 3) OVER w AS p3, lag(price, 4) OVER w AS p4 FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY n)),
lb AS MATERIALIZED (SELECT *, CASE WHEN p4 IS NOT NULL THEN CASE WHEN kind = 1 THEN p2 > p4 ELSE p1 > p3 END END AS pu, CASE WHEN p4 IS NOT NULL THEN CASE WHEN kind = 1 THEN p1 > p3 ELSE p2 > p4 END END AS vu FROM q)"""


@query("structure_labels", f"""WITH RECURSIVE {_LAB} SELECT symbol, idx, CASE WHEN pu IS NOT NULL THEN (CASE WHEN pu THEN 'HH' ELSE 'LH' END) || '/' || (CASE WHEN vu THEN 'HL' ELSE 'LL' END) END AS structure_label,
 CASE WHEN pu AND vu THEN 'up' WHEN NOT pu AND NOT vu THEN 'down' END AS trend_direction FROM lb""")
def structure_labels(spark, d):
    return S.structure_labels(S.pivots(T.bars(spark, d), 80.0)).select("symbol", "idx", "structure_label", "trend_direction")


_OB = _LAB + f""", r1 AS (SELECT *, {lag('c')} AS pc FROM b), r2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM r1),
rw AS MATERIALIZED (SELECT r2.*, {avg('v', 20)} AS av, {mx('h', 10)} AS lh, {mn('l', 10)} AS ll FROM r2),
cd AS (SELECT p.*, w.c, w.h AS zh, w.l AS zl, (SELECT min(x.idx) FROM rw x WHERE x.symbol = p.symbol AND x.idx BETWEEN p.idx + 5 AND p.idx + 49 AND (CASE WHEN p.kind = 1 THEN x.l < w.l ELSE x.h > w.h END) AND coalesce(x.v > x.av, true)) AS brk
 FROM lb p JOIN rw w ON w.symbol = p.symbol AND w.idx = p.idx WHERE NOT coalesce(CASE WHEN p.kind = 1 THEN abs(w.lh - w.h) >= 0.001 * w.h ELSE abs(w.ll - w.l) >= 0.001 * w.l END, false)),
c2 AS (SELECT cd.*, x.c AS bc, greatest(CASE WHEN kind = 1 THEN cd.c - x.c ELSE x.c - cd.c END / greatest(cd.c, 1e-9), 0) AS base FROM cd JOIN rw x ON x.symbol = cd.symbol AND x.idx = brk WHERE confirm_idx < brk),
w3 AS (SELECT c2.symbol, c2.n, c2.kind, zl, zh, base, brk, x.idx AS j, x.h AS xh, x.l AS xl, x.c AS xc, x.v AS xv, x.av AS xa FROM c2 JOIN rw x ON x.symbol = c2.symbol AND x.idx > brk AND x.idx < brk + 10 WHERE c2.idx >= 14),
bad AS (SELECT DISTINCT symbol, n FROM w3 WHERE CASE WHEN kind = 1 THEN xh > zh + 0.5 * (zh - zl) ELSE xl < zl - 0.5 * (zh - zl) END),
ok AS (SELECT *, CASE WHEN kind = 1 THEN zh - xc ELSE xc - zl END / greatest(CASE WHEN kind = 1 THEN zh ELSE zl END, 1e-9) AS rp FROM w3 WHERE (symbol, n) NOT IN (SELECT symbol, n FROM bad)
 AND CASE WHEN kind = 1 THEN xh >= zl AND xh <= zh + 0.5 * (zh - zl) ELSE xl <= zh AND xl >= zl - 0.5 * (zh - zl) END AND coalesce(xv > xa, true)),
fr AS (SELECT symbol, n, min(j) AS retest_idx FROM ok WHERE rp >= 0.002 GROUP BY 1, 2),
ob AS MATERIALIZED (SELECT ok.symbol, c2.idx, c2.kind, c2.brk AS break_idx, fr.retest_idx, ok.zl AS zone_low, ok.zh AS zone_high, greatest(0, ok.base * least(ok.xv / greatest(ok.xa, 1e-9) * least(ok.rp, 3), 10)) AS strength, c2.confirm_idx
 FROM fr JOIN ok ON ok.symbol = fr.symbol AND ok.n = fr.n AND ok.j = fr.retest_idx JOIN c2 ON c2.symbol = fr.symbol AND c2.n = fr.n)"""


@query("order_blocks", f"WITH RECURSIVE {_OB} SELECT symbol, idx, CASE WHEN kind = 1 THEN 'supply' ELSE 'demand' END AS block_type, break_idx, retest_idx, confirm_idx, zone_low, zone_high, {sr('strength')} AS strength FROM ob")
def order_blocks(spark, d):
    b = S.order_blocks(T.bars(spark, d), S.BlockConfig(reversal=80.0))
    return b.select("symbol", "idx", "block_type", "break_idx", "retest_idx", "confirm_idx", "zone_low", "zone_high", r6("strength").alias("strength"))


@query("order_blocks_filtered")
def order_blocks_filtered(spark, d):
    """Breaker bonus, oscillator and order-flow conditions together."""
    cfg = S.BlockConfig(reversal=40.0, breaker=True, rsi=(14, 20.0, 80.0), entry_mode="any", age_penalty=True, log_volume=True,
                        volume_threshold=0.5, flow_shift=True, shift_needs_extremes=False)
    b = S.order_blocks(T.bars(spark, d), cfg)
    return b.select("symbol", "idx", "block_type", "break_idx", "retest_idx", r6("strength").alias("strength"))


@query("order_blocks_clustered")
def order_blocks_clustered(spark, d):
    return S.order_blocks(T.bars(spark, d), S.BlockConfig(reversal=40.0, cluster=True, cluster_tolerance=0.1)).select(
        "symbol", "block_type", "cluster", "start_ts", "break_idx", "retest_idx", "zone_low", "zone_high", r6("strength").alias("strength"), "n_blocks")


@query("reversal_from_atr", tr_sql().rma("atr", "tr", 14, 1).text(f"SELECT symbol, {sr('2.5 * median(atr)')} AS reversal FROM $ WHERE idx BETWEEN 14 AND 213 GROUP BY 1"))
def reversal_from_atr(spark, d):
    from ..functions.volatility import atr

    rows = atr(Frame.of_numbered(T.bars(spark, d), 16)).core("symbol", "idx", "atr")
    return rounded(S.reversal_from_atr(rows, 2.5, 200), ["symbol"], ["reversal"])


# -- research detector ------------------------------------------------------
def rows(spark, d):
    """Bars with the expanding ATR and the two volume lines."""
    def build():
        f = research_atr(Frame.of_numbered(C.avsr(C.avsl(T.bars(spark, d))), 16), "atr")
        return f.core("symbol", "idx", "ts", "open", "high", "low", "close", "volume", "atr", "avsl", "avsr")

    return stored(spark, "zone_rows", d, build)


def blocks(spark, d):
    return stored(spark, "swing_blocks", d, lambda: S.swing_blocks(rows(spark, d)))


_ROWS = f"""b AS MATERIALIZED ({bars_sql()}), x0 AS (SELECT *, coalesce({lag('c')}, c) AS pc FROM b), x1 AS (SELECT *, greatest(h - l, abs(h - pc), abs(l - pc)) AS tr FROM x0), rw AS MATERIALIZED (SELECT *, CASE WHEN avg(tr) OVER {win(14)} <= 0 THEN 1e-6 ELSE avg(tr) OVER {win(14)} END AS atr, max(idx) OVER (PARTITION BY symbol) AS li,
 max(h) OVER {win(5, 1)} AS ph, min(l) OVER {win(5, 1)} AS pl, max(h) OVER nx AS nh, min(l) OVER nx AS nl, avg(c) OVER {win(51)} AS m51 FROM x1 WINDOW nx AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
_SW = _ROWS + """, sg AS (SELECT a.symbol, a.idx, min(z.c) AS dmin, max(z.c) AS dmax, arg_min(z.idx, (z.c, z.idx)) AS imin, arg_min(z.idx, (-z.c, z.idx)) AS imax FROM rw a JOIN rw z ON z.symbol = a.symbol AND z.idx BETWEEN a.idx AND a.idx + 5 GROUP BY 1, 2),
k0 AS (SELECT rw.symbol, rw.idx, rw.ts, rw.c, rw.atr, m51, li, 'supply' AS block_type, least(o, c) AS zone_low, h AS zone_high, dmin AS dd, imin AS confirm_idx FROM rw JOIN sg USING (symbol, idx) WHERE h >= ph AND h >= nh AND rw.idx >= 5 AND rw.idx + 10 <= li
 UNION ALL SELECT rw.symbol, rw.idx, rw.ts, rw.c, rw.atr, m51, li, 'demand', l, greatest(o, c), dmax, imax FROM rw JOIN sg USING (symbol, idx) WHERE l <= pl AND l <= nl AND rw.idx >= 5 AND rw.idx + 10 <= li),
k1 AS (SELECT *, 2 * idx + (block_type = 'demand')::INT AS block_id, abs(dd - c) / atr AS strength FROM k0 WHERE atr > 0 AND abs(dd - c) >= 1.5 * atr),
k2 AS (SELECT k.*, (SELECT min(z.idx) FROM rw z WHERE z.symbol = k.symbol AND z.idx > k.idx AND CASE WHEN block_type = 'supply' THEN z.c > zone_high ELSE z.c < zone_low END) AS br FROM k1 k),
k3 AS (SELECT k.*, coalesce(br, li) AS end_idx, (SELECT min(z.idx) FROM rw z WHERE z.symbol = k.symbol AND z.idx > k.idx AND z.idx <= coalesce(br, li) AND z.c BETWEEN zone_low AND zone_high) AS rt FROM k2 k),
ob AS MATERIALIZED (SELECT *, coalesce(rt, end_idx) AS retest_idx, CASE WHEN c >= m51 THEN 'up' ELSE 'down' END AS trend FROM k3)"""


@query("swing_blocks", f"""WITH {_SW} SELECT symbol, block_id, block_type, idx, zone_low, zone_high, {sr('strength')} AS strength, trend, confirm_idx, end_idx, retest_idx, CASE WHEN retest_idx < end_idx THEN 'retested' ELSE 'fresh' END AS structure FROM ob""")
def swing_blocks(spark, d):
    return blocks(spark, d).select("symbol", "block_id", "block_type", "idx", "zone_low", "zone_high", r6("strength").alias("strength"), "trend", "confirm_idx", "end_idx", "retest_idx", "structure")


_AL = _SW + """, al AS MATERIALIZED (SELECT ob.*, (SELECT min(z.idx) FROM rw z WHERE z.symbol = ob.symbol AND z.idx > ob.confirm_idx AND CASE WHEN block_type = 'demand' THEN z.c < zone_low ELSE z.c > zone_high END) AS dead FROM ob),
tc AS (SELECT al.symbol, al.block_id, al.block_type, zone_low, zone_high, z.idx AS j, row_number() OVER (PARTITION BY al.symbol, al.block_id ORDER BY z.idx) AS touch FROM al JOIN rw z ON z.symbol = al.symbol AND z.idx > al.confirm_idx AND z.idx < coalesce(dead, al.li + 1)
 WHERE CASE WHEN block_type = 'demand' THEN z.l BETWEEN zone_low AND zone_high ELSE z.h BETWEEN zone_low AND zone_high END),
e1 AS (SELECT symbol, j AS entry_idx, CASE WHEN block_type = 'demand' THEN 'long' ELSE 'short' END AS side, CASE WHEN touch = 1 THEN 'ob_touch' ELSE 'ob_retest' END AS family, zone_low, zone_high, block_id FROM tc WHERE touch <= 2),
e2 AS (SELECT al.symbol, min(z.idx) AS entry_idx, CASE WHEN block_type = 'demand' THEN 'long' ELSE 'short' END AS side, 'sweep' AS family, zone_low, zone_high, block_id FROM al JOIN rw z ON z.symbol = al.symbol AND z.idx > al.confirm_idx
 WHERE CASE WHEN block_type = 'demand' THEN z.l < zone_low - 0.5 * z.atr AND z.c > zone_low ELSE z.h > zone_high + 0.5 * z.atr AND z.c < zone_high END GROUP BY ALL),
g0 AS (SELECT *, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2 FROM rw WINDOW w AS (PARTITION BY symbol ORDER BY idx)), g1 AS (SELECT symbol, idx, l - h2 >= 0.2 * atr AS bull, CASE WHEN l - h2 >= 0.2 * atr THEN h2 ELSE h END AS zone_low, CASE WHEN l - h2 >= 0.2 * atr THEN l ELSE l2 END AS zone_high FROM g0 WHERE atr > 0 AND (l - h2 >= 0.2 * atr OR l2 - h >= 0.2 * atr)),
e3 AS (SELECT g1.symbol, min(z.idx) AS entry_idx, CASE WHEN bull THEN 'long' ELSE 'short' END AS side, 'fvg' AS family, zone_low, zone_high, -1 AS block_id FROM g1 JOIN rw z ON z.symbol = g1.symbol AND z.idx > g1.idx AND z.idx <= g1.idx + 100 WHERE CASE WHEN bull THEN z.l <= zone_high ELSE z.h >= zone_low END GROUP BY g1.symbol, g1.idx, bull, zone_low, zone_high),
e5 AS (SELECT al.symbol, min(z.idx) AS entry_idx, CASE WHEN block_type = 'demand' THEN 'short' ELSE 'long' END AS side, 'break_retest' AS family, zone_low, zone_high, block_id FROM al JOIN rw z ON z.symbol = al.symbol AND z.idx > dead AND z.idx <= dead + 200
 WHERE CASE WHEN block_type = 'demand' THEN z.h >= zone_low ELSE z.l <= zone_high END GROUP BY ALL)"""
_COLS = "SELECT symbol, entry_idx, side, family, zone_low, zone_high, block_id::BIGINT AS block_id FROM "


def _alive(spark, d):
    return stored(spark, "alive_blocks", d, lambda: S._with_invalidation(blocks(spark, d), rows(spark, d)))


@query("zone_touches", f"WITH {_AL} {_COLS} e1")
def zone_touches(spark, d):
    return S.touch_entries(_alive(spark, d), rows(spark, d))


@query("liquidity_sweeps", f"WITH {_AL} {_COLS} e2")
def liquidity_sweeps(spark, d):
    return S.sweep_entries(blocks(spark, d), rows(spark, d))


@query("fair_value_gaps", f"WITH {_AL} {_COLS} e3")
def fair_value_gaps(spark, d):
    return S.gap_entries(rows(spark, d))


@query("break_retests", f"WITH {_AL} {_COLS} e5")
def break_retests(spark, d):
    return S.break_retest_entries(_alive(spark, d), rows(spark, d))


_BN = f""", lv AS (SELECT x.symbol, x.idx, x.avsl, y.avsr FROM ({_CH1}) x JOIN ({_CH2}) y USING (symbol, idx)), e4 AS (SELECT rw.symbol, rw.idx AS entry_idx, 'long' AS side, 'avsl_bounce' AS family, avsl - 0.3 * atr AS zone_low, avsl + 0.3 * atr AS zone_high, -1 AS block_id FROM rw JOIN lv USING (symbol, idx) WHERE abs(l - avsl) <= 0.3 * atr AND rw.c > o
 UNION ALL SELECT rw.symbol, rw.idx, 'short', 'avsl_bounce', avsr - 0.3 * atr, avsr + 0.3 * atr, -1 FROM rw JOIN lv USING (symbol, idx) WHERE abs(h - avsr) <= 0.3 * atr AND rw.c < o)"""


@query("line_bounces", f"WITH {_ROWS} {_BN} SELECT symbol, entry_idx, side, family, {sr('zone_low')} AS zone_low, {sr('zone_high')} AS zone_high, block_id::BIGINT AS block_id FROM e4")
def line_bounces(spark, d):
    return S.bounce_entries(rows(spark, d)).withColumns({"zone_low": r6("zone_low"), "zone_high": r6("zone_high")})


@query("entry_candidates", f"""WITH {_AL} {_BN}, al2 AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, entry_idx, side ORDER BY list_position(['sweep', 'ob_retest', 'ob_touch', 'fvg', 'avsl_bounce', 'break_retest'], family), block_id, zone_low, zone_high) AS k, min(family) OVER p <> max(family) OVER p AS overlap FROM al2 WINDOW p AS (PARTITION BY symbol, entry_idx, side))
SELECT symbol, entry_idx, side, family, {sr('zone_low')} AS zone_low, {sr('zone_high')} AS zone_high, block_id::BIGINT AS block_id, overlap FROM rk WHERE k = 1""")
def entry_candidates(spark, d):
    e = stored(spark, "entry_candidates", d, lambda: S.collect_entries(blocks(spark, d), rows(spark, d)))
    return e.withColumns({"zone_low": r6("zone_low"), "zone_high": r6("zone_high")})


@query("zone_overlay", f"WITH {_SW} SELECT rw.symbol, rw.idx, arg_min(zone_low, block_id) AS zone FROM ob JOIN rw ON rw.symbol = ob.symbol AND rw.idx BETWEEN end_idx AND end_idx + 1999 WHERE block_type = 'demand' GROUP BY 1, 2")
def zone_overlay(spark, d):
    return S.paint_zone(blocks(spark, d), rows(spark, d), "long")


@query("block_distances", f"""WITH {_SW}, p AS (SELECT rw.symbol, rw.idx, block_type, strength, block_id, abs(rw.c - (zone_low + zone_high) / 2) / rw.atr AS dd, rw.c BETWEEN zone_low AND zone_high AS ins FROM ob JOIN rw ON rw.symbol = ob.symbol AND rw.idx BETWEEN ob.idx AND end_idx),
g AS (SELECT symbol, idx, min(CASE WHEN block_type = 'supply' THEN dd END) AS ns, min(CASE WHEN block_type = 'demand' THEN dd END) AS nd, arg_max(dd, (strength, -block_id)) AS st, max(ins::INT)::DOUBLE AS iz FROM p GROUP BY 1, 2)
SELECT rw.symbol, rw.idx, {sr('coalesce(ns, 999)')} AS near_supply, {sr('coalesce(nd, 999)')} AS near_demand, {sr('coalesce(st, 999)')} AS strongest, coalesce(iz, 0) AS in_zone FROM rw LEFT JOIN g USING (symbol, idx)""")
def block_distances(spark, d):
    return rounded(S.block_distances(blocks(spark, d), rows(spark, d)), ["symbol", "idx"], ["near_supply", "near_demand", "strongest", "in_zone"])


_FEAT = ["dist", "in_zone", "strength", "height", "age", "retested", "count", "broken"]


def _feature_sql(kind: str) -> str:
    return f"""SELECT rw.symbol, rw.idx, arg_min(abs(rw.c - (zone_low + zone_high) / 2) / rw.atr, (abs(rw.c - (zone_low + zone_high) / 2) / rw.atr, block_id)) AS dist, max((rw.c BETWEEN zone_low AND zone_high)::INT) AS in_zone,
 arg_min(strength, (abs(rw.c - (zone_low + zone_high) / 2) / rw.atr, block_id)) AS strength, arg_min((zone_high - zone_low) / rw.atr, (abs(rw.c - (zone_low + zone_high) / 2) / rw.atr, block_id)) AS height,
 arg_min(rw.idx - confirm_idx, (abs(rw.c - (zone_low + zone_high) / 2) / rw.atr, block_id)) AS age, max((retest_idx < end_idx AND rw.idx >= retest_idx)::INT) AS retested, least(count(*), 10) / 10.0 AS count
 FROM ob JOIN rw ON rw.symbol = ob.symbol AND rw.idx BETWEEN confirm_idx AND end_idx WHERE block_type = '{kind}' GROUP BY 1, 2"""


@query("block_features", f"WITH {_SW}" + "".join(f", f_{k} AS ({_feature_sql(k)}), k_{k} AS (SELECT DISTINCT rw.symbol, rw.idx, 1.0 AS broken FROM ob JOIN rw ON rw.symbol = ob.symbol AND rw.idx BETWEEN end_idx + 1 AND end_idx + 50 WHERE block_type = '{k}')" for k in ("supply", "demand"))
       + " SELECT rw.symbol, rw.idx, " + ", ".join(f"{sr(f'f_{k}.{n}' if n == 'dist' else (f'coalesce(k_{k}.broken, 0)' if n == 'broken' else f'coalesce(f_{k}.{n}, 0)'))} AS {n}_{k}" for k in ("supply", "demand") for n in _FEAT)
       + " FROM rw " + " ".join(f"LEFT JOIN f_{k} ON f_{k}.symbol = rw.symbol AND f_{k}.idx = rw.idx LEFT JOIN k_{k} ON k_{k}.symbol = rw.symbol AND k_{k}.idx = rw.idx" for k in ("supply", "demand")))
def block_features(spark, d):
    return rounded(S.block_features(blocks(spark, d), rows(spark, d)), ["symbol", "idx"], [f"{n}_{k}" for k in ("supply", "demand") for n in _FEAT])


@query("break_retest_delays", f"WITH {_SW} SELECT block_type, ((retest_idx - confirm_idx) // 10)::BIGINT AS delay, count(*) AS n FROM ob WHERE retest_idx < end_idx AND retest_idx >= confirm_idx GROUP BY 1, 2")
def break_retest_delays(spark, d):
    b = blocks(spark, d).filter((c("retest_idx") < c("end_idx")) & (c("retest_idx") >= c("confirm_idx")))
    return b.groupBy("block_type", F.floor((c("retest_idx") - c("confirm_idx")) / 10).alias("delay")).agg(F.count(F.lit(1)).alias("n"))


@query("detector_funnel", f"""WITH {_ROWS}, y AS (SELECT *, h >= ph AND h >= nh AND idx >= 5 AND idx + 10 <= li AS sw FROM rw) SELECT symbol, count(*) AS bars, count_if(sw)::BIGINT AS swings, count_if(sw AND h - l > atr)::BIGINT AS wide, count_if(sw AND h - l > atr AND v > 1)::BIGINT AS traded FROM y GROUP BY 1""")
def detector_funnel(spark, d):
    f = Frame.of_numbered(rows(spark, d), 5, 11)
    full = (F.count("high").over(f.rows(5, 1)) == 5) & (F.count("high").over(f.next_rows(10)) == 10)
    f = f.add(sw=full & (c("high") >= F.max("high").over(f.rows(5, 1))) & (c("high") >= F.max("high").over(f.next_rows(5))))
    wide = c("sw") & (c("high") - c("low") > c("atr"))
    return f.core().groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if("sw").alias("swings"), F.count_if(wide).alias("wide"), F.count_if(wide & (c("volume") > 1)).alias("traded"))


@query("map_higher_blocks", f"""WITH {_SW}, d0 AS (SELECT symbol, ts // 86400000 AS dy, count(*) AS n FROM b GROUP BY 1, 2), d1 AS (SELECT symbol, dy * 86400000 AS ts, row_number() OVER (PARTITION BY symbol ORDER BY dy) - 1 AS idx FROM d0)
SELECT d1.symbol, d1.idx, (SELECT min(z.idx) FROM b z WHERE z.symbol = d1.symbol AND z.ts >= d1.ts + 86400000 - 3600000) AS base_idx FROM d1""")
def map_higher_blocks(spark, d):
    b = T.bars(spark, d)
    day = number_bars(resample(b, DAY_MS, HOUR_MS, drop_partial=False), DAY_MS)
    return S.map_to_base(day.select("symbol", "idx"), day, b, DAY_MS, HOUR_MS, ["idx"]).select("symbol", "idx", "base_idx")
