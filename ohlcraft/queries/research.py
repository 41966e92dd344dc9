"""Panel, splits, models, factor studies, carry, options, streaming and archive operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import volatility as V
from ..operators import kernels as K
from ..operators import states as SM
from ..operators.asof import asof
from ..operators.fold import fold
from ..operators.frames import DAY_MS, HOUR_MS, WEEK_MS, Frame, number_bars, ordinals
from ..operators.resample import common_buckets, resample
from ..plans import archive as AR
from ..plans import crosssection as X
from ..plans import factors as FA
from ..plans import inference as IN
from ..plans import spectra as SP
from ..plans import models as ML
from ..plans import outcomes as O
from ..plans import panel as PN
from ..plans import portfolio as P
from ..plans import rulebook as RB
from ..plans import signals as G
from ..sources import tables as T
from ..sources.store import shared_dir, stored
from ..streaming import bars as ST
from .base import ORACLES, ORD, USERS_SQL, Sql, avg, bars_sql, brands_sql, div, full, indicator, lag, query, r6, register, rounded, sr, win
from .core import _resample_sql
from .structure import _AL, _BN, _SW, _Z as _ZIGZAG, blocks, rows
from .trading import BOOK, EV, SIG, TR, book, fills, hash_sql, sig, stream, trades
from .volatility import _ADX, supertrend_sql

c = F.col
B = f"b AS MATERIALIZED ({bars_sql()})"
BR = f"b AS MATERIALIZED ({brands_sql()})"


# -- more recursive averages -------------------------------------------------
def _price_fold(name, kernel, outs, hide=0):
    def run(spark, d):
        out = fold(T.bars(spark, d).withColumn("x", c("close")), kernel, ["x"], {o: "double" for o in outs}, warmup=1024)
        return out.select("symbol", "idx", *[F.when(c("idx") >= hide, r6(o)).alias(o) for o in outs])

    register(name, run)


_price_fold("mama", K.adaptive_phase(), ["mama", "fama"], 3)
_price_fold("jma", K.jurik(7, 0.0), ["y"], 6)


# -- positions ---------------------------------------------------------------
def _z_rows(spark, d, adx=False, prev=False):
    f = Frame.of_numbered(T.bars(spark, d), 32)
    if adx:
        f = V.adx(f)
    f = f.add(z=R.ratio(c("close") - R.mean(f, "close", 20), R.std(f, "close", 20, 0)))
    if prev:
        f = f.add(pz=f.lag(c("z")))
    return f.core("symbol", "idx", "z", *(["adx"] if adx else []), *(["pz"] if prev else []))


def _states(rows, moves):
    return SM.states(rows, moves, "pos").select("symbol", "idx", c("pos").cast("long").alias("pos"))


_Z = Sql().add(z=div(f"c - {avg('c', 20)}", full("stddev_pop(c)", "c", 20))).add(pz=lag("z"))
query("reversion_position", _Z.loop("pos", "CASE WHEN z <= -1.5 THEN 1 WHEN z >= 1.5 THEN -1 ELSE 0 END",
      "CASE WHEN n.z IS NULL THEN p.pos WHEN n.z <= -1.5 THEN 1 WHEN n.z >= 1.5 THEN -1 WHEN p.pos = 1 AND n.z >= 0.2 THEN 0 WHEN p.pos = -1 AND n.z <= -0.2 THEN 0 ELSE p.pos END").text(
      "SELECT symbol, idx, pos::BIGINT AS pos FROM $"))(lambda spark, d: _states(_z_rows(spark, d), SM.reversion(c("z"), 1.5, 0.2)))
_Z2 = Sql().add(z=div(f"c - {avg('c', 20)}", full("stddev_pop(c)", "c", 20))).add(pz=lag("z"))
query("momentum_position", _Z2.loop("pos", "0",
      "CASE WHEN n.z IS NULL OR n.pz IS NULL THEN p.pos WHEN p.pos = 1 AND n.z >= 0.2 THEN 1 WHEN p.pos = -1 AND n.z <= -0.2 THEN -1 WHEN n.pz <= 1 AND n.z > 1 THEN 1 WHEN n.pz >= -1 AND n.z < -1 THEN -1 ELSE 0 END").text(
      "SELECT symbol, idx, pos::BIGINT AS pos FROM $"))(lambda spark, d: _states(_z_rows(spark, d, prev=True), SM.momentum(c("z"), c("pz"), 1.0, 0.2)))
_H = _ADX.add(z=div(f"c - {avg('c', 20)}", full("stddev_pop(c)", "c", 20)))
query("hybrid_position", _H.loop("hp", "0", "CASE WHEN n.z IS NULL OR n.adx IS NULL THEN p.hp WHEN n.adx < 15 THEN CASE WHEN n.z <= -1.5 THEN 1 WHEN n.z >= 1.5 THEN -1 WHEN abs(n.z) <= 0.5 THEN 0 ELSE p.hp END "
      "WHEN n.adx > 20 THEN CASE WHEN p.hp = 0 AND n.z > 1 THEN 1 WHEN p.hp = 0 AND n.z < -1 THEN -1 WHEN p.hp * n.z < 0 THEN 0 ELSE p.hp END ELSE p.hp END").text("SELECT symbol, idx, hp::BIGINT AS pos FROM $"))(lambda spark, d: _states(_z_rows(spark, d, True), SM.hybrid(c("z"), c("adx"), 15.0, 20.0, 1.5)))


# -- splits ------------------------------------------------------------------
_N = f"WITH {B}, m AS (SELECT *, max(idx) OVER (PARTITION BY symbol) + 1 AS n FROM b)"


def _with_n(spark, d):
    b = T.bars(spark, d).select("symbol", "idx", "ts", "close")
    return b.join(b.groupBy("symbol").agg((F.max("idx") + 1).alias("n")), "symbol")


@query("purged_split", _N + " SELECT symbol, idx, CASE WHEN idx + 24 < floor(n * 0.6) THEN 'train' WHEN idx >= floor(n * 0.6) + 24 AND idx < floor(n * 0.8 + 1e-9) - 24 THEN 'val' WHEN idx >= floor(n * 0.8 + 1e-9) + 24 THEN 'test' END AS split FROM m")
def purged_split(spark, d):
    return PN.purged_split(_with_n(spark, d), c("n"), 24).select("symbol", "idx", "split")


@query("gap_split", _N + """, q AS (SELECT *, floor((n - 60) * 0.7)::BIGINT AS nt, floor((n - 60) * 0.15)::BIGINT AS nv FROM m), s AS (SELECT symbol, idx, 'train' AS split, idx AS pos FROM q WHERE idx < nt
 UNION ALL SELECT symbol, idx, 'val', idx - nt - 30 FROM q WHERE idx >= nt AND idx < nt + 30 + nv UNION ALL SELECT symbol, idx, 'test', idx - nt - nv - 60 FROM q WHERE idx >= nt + nv + 30) SELECT * FROM s""")
def gap_split(spark, d):
    return PN.gap_split(_with_n(spark, d), c("n"), 30).select("symbol", "idx", "split", "pos")


@query("walk_forward_folds", f"""WITH {B}, e AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM b), f AS (SELECT unnest(range(greatest((t1 - t0) // 432000000 - 3, 0), (t1 - t0) // 432000000 + 1)) AS fold, t0 FROM e)
SELECT fold, CASE WHEN ts >= t0 + fold * 432000000 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM b, f WHERE (ts >= t0 + fold * 432000000 AND ts < t0 + (fold + 1) * 432000000) OR ts < t0 + fold * 432000000 - 86400000 GROUP BY 1, 2""")
def walk_forward_folds(spark, d):
    w = PN.walk_forward(T.bars(spark, d).select("symbol", "ts"), 4, 5, 1)
    return w.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("nested_folds", f"""WITH {B}, r AS (SELECT symbol, ts FROM b), t AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM r), f AS (SELECT w AS fold, t0 + w * 432000000 AS a, t0 + (w + 1) * 432000000 AS z FROM t, (SELECT unnest(range(0, 400)) AS w) q WHERE w >= greatest((t1 - t0) // 432000000 - 4 + 1, 0) AND w <= (t1 - t0) // 432000000),
tr AS (SELECT fold, ts, row_number() OVER (PARTITION BY fold ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n FROM f JOIN r ON ts < a - 86400000), cu AS (SELECT fold, ts AS cut FROM tr WHERE k = floor(n * 0.8 + 1e-9)),
p AS (SELECT fold, CASE WHEN ts >= a AND ts < z THEN 'test' WHEN ts < a - 86400000 THEN 'train' END AS part FROM f, r UNION ALL SELECT fold, CASE WHEN ts < cut THEN 'inner_train' WHEN ts >= cut + 86400000 THEN 'inner_val' END FROM tr JOIN cu USING (fold))
SELECT fold, part, count(*) AS rows FROM p WHERE part IS NOT NULL GROUP BY 1, 2""")
def nested_folds(spark, d):
    b = T.bars(spark, d).select("symbol", "ts")
    m = PN.with_folds(b, PN.nested_folds(b, 4, 5, 1, 0.2, 1))
    return m.select(F.explode("folds").alias("f")).groupBy(c("f.fold").alias("fold"), c("f.part").alias("part")).agg(F.count(F.lit(1)).alias("rows"))


@query("rolling_windows", _N + """, f AS (SELECT unnest(range(0, 40)) AS "window") SELECT symbol, "window", CASE WHEN idx < "window" * 50 + 100 THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM m, f WHERE idx >= "window" * 50 AND idx < "window" * 50 + 150 AND "window" * 50 + 150 <= n GROUP BY ALL""")
def rolling_windows(spark, d):
    w = PN.rolling_windows(_with_n(spark, d), 100, 50, 50, c("n"))
    return w.groupBy("symbol", "window", "part").agg(F.count(F.lit(1)).alias("rows"))


@query("temporal_split", _N + " SELECT symbol, CASE WHEN idx < floor(n * 0.7) THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM m GROUP BY 1, 2")
def temporal_split(spark, d):
    w = _with_n(spark, d).withColumn("part", F.when(c("idx") < F.floor(c("n") * 0.7), "train").otherwise("test"))
    return w.groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("rows"))


# -- panel -------------------------------------------------------------------
def features(spark, d):
    """Bars with trend state, regime and zone overlay."""
    def build():
        f = PN.trend_state(Frame.of_numbered(rows(spark, d), 62))
        f = f.add(bb_m=R.mean(f, "close", 20), bb_s=R.std(f, "close", 20, 0))
        f = V.hilo(f).core("symbol", "idx", "ts", "open", "high", "low", "close", "volume", "atr", "avsl", "avsr", "z", "slope", "trend",
                           (c("bb_m") - 2 * c("bb_s")).alias("a_bb_l"), (c("bb_m") + 2 * c("bb_s")).alias("a_bb_u"), c("hilo_long").alias("a_hilo_l"), c("hilo_short").alias("a_hilo_s"))
        return f.join(V.supertrend(T.bars(spark, d)).select("symbol", "idx", c("trend").alias("a_st")), ["symbol", "idx"])

    return stored(spark, "panel_rows", d, build)


_FE = Sql().add(p=f"coalesce({lag('c')}, c)").add(tr="greatest(h - l, abs(h - p), abs(l - p))").add(atr=f"CASE WHEN avg(tr) OVER {win(14)} <= 0 THEN 1e-6 ELSE avg(tr) OVER {win(14)} END", a50=avg("c", 50)).add(
    z="CASE WHEN atr > 0 THEN (c - a50) / atr END", slope=f"CASE WHEN atr > 0 AND a50 IS NOT NULL THEN (a50 - {lag('a50', 10)}) / atr END")


@query("trend_state", _FE.text(f"SELECT symbol, idx, {sr('z')} AS z, {sr('slope')} AS slope, CASE WHEN z IS NULL THEN 0 WHEN c >= a50 THEN 1 ELSE -1 END AS trend, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 0.5 THEN 'up' WHEN z < -0.5 THEN 'down' ELSE 'range' END AS regime FROM $"))
def trend_state(spark, d):
    return features(spark, d).select("symbol", "idx", r6("z").alias("z"), r6("slope").alias("slope"), "trend", PN.regime_of(c("z")).alias("regime"))


@query("impulse_features", Sql().add(sd=f"stddev_pop(v) OVER {win(20)}", av=f"avg(v) OVER {win(20)}").add(vol_z="CASE WHEN sd > 0 THEN (v - av) / sd ELSE 0 END", move=f"c - {lag('c', 6)}").out("move", "vol_z"))
def impulse_features(spark, d):
    return rounded(PN.impulse_features(Frame.of_numbered(T.bars(spark, d), 22), 6, 20).core(), ["symbol", "idx"], ["move", "vol_z"])


@query("percentile_features", Sql().add(p=f"coalesce({lag('c')}, c)").add(tr="greatest(h - l, abs(h - p), abs(l - p))").add(atr=f"CASE WHEN avg(tr) OVER {win(14)} <= 0 THEN 1e-6 ELSE avg(tr) OVER {win(14)} END").add(ap="atr / c", bw=f"4 * {full('stddev_pop(c)', 'c', 20)} / {avg('c', 20)}").add(
    w1=f"list(ap) OVER {win(100)}", w2=f"list(bw) FILTER (WHERE bw IS NOT NULL) OVER {win(100)}").add(vol_pct="len(list_filter(w1, lambda x: x <= ap)) / len(w1)::DOUBLE", bbw_pct="CASE WHEN bw IS NOT NULL THEN len(list_filter(w2, lambda x: x <= bw)) / len(w2)::DOUBLE END").out("vol_pct", "bbw_pct", digits=4))
def percentile_features(spark, d):
    f = Frame.of_numbered(rows(spark, d), 122)
    return rounded(PN.percentile_features(f, 100).core(), ["symbol", "idx"], ["vol_pct", "bbw_pct"], 4)


@query("normalised_features", f"WITH {B}, m AS (SELECT symbol, median(c) AS mc, median(v) AS mv FROM b WHERE idx < 500 GROUP BY 1) SELECT symbol, idx, {sr('c / mc')} AS close, {sr('h / mc')} AS high, {sr('ln(1 + v / mv)')} AS volume FROM b JOIN m USING (symbol)")
def normalised_features(spark, d):
    return rounded(PN.normalise(T.bars(spark, d), ["close", "high"]), ["symbol", "idx"], ["close", "high", "volume"])


@query("feature_sequences", Sql().add(w=f"CASE WHEN count(c) OVER {win(8)} = 8 THEN list(c) OVER {win(8)} END").text("SELECT symbol, idx, w[1] AS oldest, w[8] AS newest, len(w)::INTEGER AS n FROM $"))
def feature_sequences(spark, d):
    f = PN.sequences(Frame.of_numbered(T.bars(spark, d), 8), ["close", "volume"], 8)
    return f.core("symbol", "idx", c("window")[0]["close"].alias("oldest"), c("window")[7]["close"].alias("newest"), F.size("window").alias("n")).withColumn("n", F.when(c("n") > 0, c("n")))


def cands(spark, d):
    """Entry candidates with the features of their decision bar."""
    from ..plans import structure as S

    e = stored(spark, "entry_candidates", d, lambda: S.collect_entries(blocks(spark, d), rows(spark, d)))
    f = features(spark, d)
    e = e.withColumnRenamed("entry_idx", "idx").withColumn("is_long", c("side") == "long")
    j = e.join(f, ["symbol", "idx"])
    return j.withColumns({"zone": F.when(c("is_long"), c("zone_low")).otherwise(c("zone_high")), "regime": PN.regime_of(c("z")), "a_avsl": c("avsl"), "a_avsr": c("avsr")})


def candidate_bars(spark, d):
    """Decision bars with the states of 4 hours, a day and 15 minutes as last known."""
    def build():
        own = PN.percentile_features(Frame.of_numbered(features(spark, d), 122), 100).core().withColumns({"a_avsl": c("avsl"), "a_avsr": c("avsr")})
        b, quarter = T.bars(spark, d), HOUR_MS // 4
        longer = lambda ms, n, k: PN.higher_states(number_bars(resample(b, ms, HOUR_MS), ms), n, k)
        return PN.carried(own, {"h1": longer(4 * HOUR_MS, 10, 4), "h2": longer(DAY_MS, 5, 2), "ltf": PN.lower_states(T.bars(spark, d, quarter), quarter, 6, 20)})

    return stored(spark, "candidate_bars", d, build)


def _longer_sql(ms: int, n: int, k: int) -> str:
    src = f"SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, open AS o, high AS h, low AS l, close AS c, volume AS v, known_ts FROM ({_resample_sql(ms)})"
    return f"""(WITH {_SW.replace(bars_sql(), src)}, t0 AS (SELECT symbol, idx, known_ts, c, atr, {avg('c', n)} AS a FROM rw), t1 AS (SELECT *, {lag('a', k)} AS pa FROM t0),
 nz AS (SELECT rw.symbol, rw.idx, min(CASE WHEN zone_high <= rw.c THEN rw.c - zone_high WHEN zone_low < rw.c THEN 0 END) AS below, min(CASE WHEN zone_high <= rw.c THEN NULL WHEN zone_low >= rw.c THEN zone_low - rw.c ELSE 0 END) AS above FROM rw JOIN ob ON ob.symbol = rw.symbol AND ob.confirm_idx <= rw.idx GROUP BY 1, 2)
 SELECT t1.symbol, known_ts, CASE WHEN a IS NULL OR atr <= 0 THEN 0 WHEN c >= a THEN 1 ELSE -1 END AS trend, coalesce((a - pa) / atr, 0) AS slope, below, above FROM t1 LEFT JOIN nz USING (symbol, idx))"""


def _features_sql() -> str:
    d = lambda x: f"{sr(f'(rw.c - {x}) * sg / rw.atr', 3)}"
    names = {"atr_pct": "rw.atr / rw.c", "zone_height_atr": "(cn.zone_high - cn.zone_low) / rw.atr", "zone_dist_atr": "(rw.c - CASE WHEN sg > 0 THEN cn.zone_low ELSE cn.zone_high END) * sg / rw.atr",
             "z50": "z", "slope50": "slope50", "vol_pct": "vol_pct", "bbw_pct": "bbw_pct"}
    levels = {"avsl": "lv.avsl", "avsr": "lv.avsr", "hilo_l": "hl.hilo_long", "hilo_s": "hl.hilo_short", "st": "tl.trend", "bb_l": "(m20 - 2 * s20)", "bb_u": "(m20 + 2 * s20)"}
    cols = [f"{sr(v, 3)} AS {k}" for k, v in names.items()] + [f"{d(v)} AS d_{k}" for k, v in levels.items()]
    for k in (1, 2):
        cols += [f"coalesce(h{k}.trend, 0)::DOUBLE AS h{k}_trend", f"{sr(f'coalesce(h{k}.slope, 0)', 3)} AS h{k}_slope", f"{sr(f'h{k}.below / rw.atr', 3)} AS h{k}_below", f"{sr(f'h{k}.above / rw.atr', 3)} AS h{k}_above"]
    cols += [f"{sr('q.move / rw.atr', 3)} AS ltf_impulse", f"{sr('q.vol_z', 3)} AS ltf_vol_z"]
    quarter = bars_sql(HOUR_MS // 4)
    w20 = "(PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return f"""WITH RECURSIVE {_AL} {_BN}, hl AS MATERIALIZED ({ORACLES["hilo"]}), tl AS MATERIALIZED (SELECT symbol, idx, trend FROM ({ORACLES["supertrend"]})), h1 AS MATERIALIZED {_longer_sql(4 * HOUR_MS, 10, 4)}, h2 AS MATERIALIZED {_longer_sql(DAY_MS, 5, 2)},
q0 AS MATERIALIZED (SELECT *, stddev_pop(v) OVER {w20} AS sd, avg(v) OVER {w20} AS av FROM ({quarter})), q AS MATERIALIZED (SELECT symbol, ts + 900000 AS known_ts, CASE WHEN idx >= 6 THEN c - lag(c, 6) OVER (PARTITION BY symbol ORDER BY idx) END AS move, CASE WHEN idx >= 6 THEN CASE WHEN sd > 0 THEN (v - av) / sd ELSE 0 END END AS vol_z FROM q0),
al2 AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, entry_idx, side ORDER BY list_position(['sweep', 'ob_retest', 'ob_touch', 'fvg', 'avsl_bounce', 'break_retest'], family), block_id, zone_low, zone_high) AS k, min(family) OVER p <> max(family) OVER p AS overlap FROM al2 WINDOW p AS (PARTITION BY symbol, entry_idx, side)),
cn AS (SELECT symbol, entry_idx AS idx, side, family, zone_low, zone_high, block_id, overlap, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg FROM rk WHERE k = 1),
p0 AS (SELECT *, {avg('c', 50)} AS a50, {avg('c', 20)} AS m20, {full('stddev_pop(c)', 'c', 20)} AS s20, atr / c AS ap FROM rw), p1 AS (SELECT *, 4 * s20 / m20 AS bw, (c - a50) / atr AS z, (a50 - {lag('a50', 10)}) / atr AS slope50 FROM p0),
p2 AS (SELECT *, list(ap) OVER {win(100)} AS w1, list(bw) FILTER (WHERE bw IS NOT NULL) OVER {win(100)} AS w2 FROM p1),
p3 AS MATERIALIZED (SELECT *, len(list_filter(w1, lambda x: x <= ap)) / len(w1)::DOUBLE AS vol_pct, CASE WHEN bw IS NOT NULL THEN len(list_filter(w2, lambda x: x <= bw)) / len(w2)::DOUBLE END AS bbw_pct FROM p2)
SELECT cn.symbol, cn.idx, {', '.join(cols)}, cn.side, family, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 0.5 THEN 'up' WHEN z < -0.5 THEN 'down' ELSE 'range' END AS regime_dir, coalesce(ob.trend, 'none') AS ob_trend,
 CASE WHEN ob.symbol IS NULL THEN 'none' WHEN ob.retest_idx < ob.end_idx THEN 'retested' ELSE 'fresh' END AS ob_structure, overlap
FROM cn JOIN p3 rw USING (symbol, idx) LEFT JOIN lv USING (symbol, idx) LEFT JOIN hl USING (symbol, idx) LEFT JOIN tl USING (symbol, idx) LEFT JOIN ob ON ob.symbol = cn.symbol AND ob.block_id = cn.block_id
ASOF LEFT JOIN h1 ON h1.symbol = cn.symbol AND rw.ts >= h1.known_ts ASOF LEFT JOIN h2 ON h2.symbol = cn.symbol AND rw.ts >= h2.known_ts ASOF LEFT JOIN q ON q.symbol = cn.symbol AND rw.ts >= q.known_ts"""


@query("candidate_features", _features_sql())
def candidate_features(spark, d):
    from ..plans import structure as S

    e = stored(spark, "entry_candidates", d, lambda: S.collect_entries(blocks(spark, d), rows(spark, d))).withColumnRenamed("entry_idx", "idx")
    f = PN.feature_rows(e, candidate_bars(spark, d), blocks(spark, d))
    return f.select("symbol", "idx", *[r6(x, 3).alias(x) for x in PN.NUMERIC], *PN.CATEGORICAL)


def panel(spark, d):
    keep = ["symbol", "idx", "ts", "is_long", "side", "family", "regime", "overlap", "close", "atr", "z", "slope", "zone", "zone_low", "zone_high",
            "a_avsl", "a_avsr", "a_hilo_l", "a_hilo_s", "a_st", "a_bb_l", "a_bb_u"]
    return stored(spark, "outcome_panel", d, lambda: PN.outcome_panel(
        cands(spark, d).select(*keep), rows(spark, d), RULES, PN.TARGETS, hold=24, min_risk_atr=0.4))


#: Every stop rule, and one whose distance fits bars of an hour.
RULES = ["atr:2", *PN.STOP_RULES]
_HILO = Sql().add(hm=avg("h", 13), lm=avg("l", 21)).add(way=f"CASE WHEN c > {lag('hm')} THEN 1 WHEN c < {lag('lm')} THEN -1 END").add(grp=f"count(way) OVER {ORD}").add(
    hilo="first_value(CASE WHEN way = 1 THEN lm WHEN way = -1 THEN hm END) OVER (PARTITION BY symbol, grp ORDER BY idx)").text(
    "SELECT symbol, idx, CASE WHEN way IS NULL OR way = 1 THEN hilo END AS hilo_long, CASE WHEN way IS NULL OR way = -1 THEN hilo END AS hilo_short FROM $")
_RULES_SQL = ", ".join(f"('{r}', '{r.split(':')[1] if r.startswith('anchor') else r.split(':')[0]}', {r.split(':')[-1]}::DOUBLE)" for r in RULES)


_PN = f"WITH {_AL} {_BN}, hl AS MATERIALIZED ({_HILO}), tl AS MATERIALIZED ({supertrend_sql(7, 3.0)[0]} SELECT symbol, idx, trend FROM st), bb AS (SELECT symbol, idx, {avg('c', 20)} - 2 * {full('stddev_pop(c)', 'c', 20)} AS bb_l, {avg('c', 20)} + 2 * {full('stddev_pop(c)', 'c', 20)} AS bb_u FROM rw), al2 AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5), " + """
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, entry_idx, side ORDER BY list_position(['sweep', 'ob_retest', 'ob_touch', 'fvg', 'avsl_bounce', 'break_retest'], family), block_id, zone_low, zone_high) AS k FROM al2),
cn AS MATERIALIZED (SELECT rk.symbol, entry_idx AS idx, side = 'long' AS is_long, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg, zone_low, zone_high, CASE WHEN side = 'long' THEN zone_low ELSE zone_high END AS zone, rw.c AS close, rw.atr, lv.avsl, lv.avsr, hilo_long, hilo_short, tl.trend AS st_line, bb_l, bb_u
 FROM rk JOIN rw ON rw.symbol = rk.symbol AND rw.idx = entry_idx LEFT JOIN lv ON lv.symbol = rk.symbol AND lv.idx = entry_idx LEFT JOIN hl ON hl.symbol = rk.symbol AND hl.idx = entry_idx
 LEFT JOIN tl ON tl.symbol = rk.symbol AND tl.idx = entry_idx LEFT JOIN bb ON bb.symbol = rk.symbol AND bb.idx = entry_idx WHERE k = 1),
ex AS (SELECT cn.*, 'market' AS execution, cn.idx + 1 AS fill_idx, z.o * (1 + sg * 0.0005) AS fill FROM cn JOIN rw z ON z.symbol = cn.symbol AND z.idx = cn.idx + 1
 UNION ALL SELECT * FROM (SELECT cn.*, q.k AS execution, (SELECT min(z.idx) FROM rw z WHERE z.symbol = cn.symbol AND z.idx BETWEEN cn.idx + 1 AND cn.idx + 5 AND CASE WHEN is_long THEN z.l <= CASE WHEN q.k = 'limit:edge' THEN cn.zone ELSE (zone_low + zone_high) / 2 END - 0.1 * z.atr ELSE z.h >= CASE WHEN q.k = 'limit:edge' THEN cn.zone ELSE (zone_low + zone_high) / 2 END + 0.1 * z.atr END) AS fill_idx,
  CASE WHEN q.k = 'limit:edge' THEN cn.zone ELSE (zone_low + zone_high) / 2 END AS fill FROM cn JOIN rw nx ON nx.symbol = cn.symbol AND nx.idx = cn.idx + 1, (SELECT unnest(['limit:edge', 'limit:mid']) AS k) q)),
rl AS MATERIALIZED (SELECT ex.*, rule, goal, CASE kind WHEN 'atr' THEN close WHEN 'zone' THEN zone WHEN 'avsl' THEN CASE WHEN is_long THEN avsl END WHEN 'avsr' THEN CASE WHEN NOT is_long THEN avsr END
 WHEN 'hilo' THEN CASE WHEN is_long THEN hilo_long ELSE hilo_short END WHEN 'st' THEN st_line ELSE CASE WHEN is_long THEN bb_l ELSE bb_u END END - sg * dist * atr AS stop FROM ex, (VALUES """ + _RULES_SQL + """) r(rule, kind, dist), (SELECT unnest([2.0, 3.0])::DOUBLE AS goal) t),
gd AS MATERIALIZED (SELECT *, fill + sg * goal * abs(fill - stop) AS target FROM (SELECT *, CASE WHEN abs(close - stop) > 0 THEN stop END AS s2 FROM rl) WHERE fill_idx IS NOT NULL AND s2 IS NOT NULL AND sg * (fill - stop) >= 0 AND abs(fill - stop) >= 0.4 * atr),
wk AS (SELECT g.symbol, g.idx, g.is_long, execution, rule, goal, min(CASE WHEN (is_long AND z.l <= stop) OR (NOT is_long AND z.h >= stop) THEN z.idx * 2 WHEN (is_long AND z.h >= target) OR (NOT is_long AND z.l <= target) THEN z.idx * 2 + 1 END) AS code, max(z.idx) AS lj, arg_max(z.c, z.idx) AS lc
 FROM gd g JOIN rw z ON z.symbol = g.symbol AND z.idx BETWEEN fill_idx AND fill_idx + 24 GROUP BY ALL),
oc AS MATERIALIZED (SELECT g.*, CASE WHEN code IS NOT NULL THEN code // 2 WHEN lj = fill_idx + 24 THEN lj END AS exit_idx, CASE WHEN code % 2 = 0 THEN 'sl' WHEN code % 2 = 1 THEN 'tp' WHEN lj = fill_idx + 24 THEN 'time' END AS exit_reason,
 sg * (CASE WHEN code % 2 = 0 THEN stop * (1 - sg * 0.0005) WHEN code % 2 = 1 THEN target WHEN lj = fill_idx + 24 THEN lc * (1 - sg * 0.0005) END - fill) / nullif(abs(fill - stop), 0) - 0.0025 * fill / nullif(abs(fill - stop), 0) AS r_net FROM gd g LEFT JOIN wk USING (symbol, idx, is_long, execution, rule, goal))"""


@query("outcome_panel", _PN + f"SELECT rl.symbol, rl.idx, rl.is_long, rl.execution, rl.rule, rl.goal AS target_r, exit_idx, exit_reason, {sr('r_net', 5)} AS r_net FROM rl LEFT JOIN oc USING (symbol, idx, is_long, execution, rule, goal)")
def outcome_panel(spark, d):
    return panel(spark, d).select("symbol", "idx", "is_long", "execution", "rule", "target_r", "exit_idx", "exit_reason", r6("r_net", 5).alias("r_net"))


_P3 = "target_r = 2.0 and execution = 'market'"


@query("regime_stats", _PN + f", rg AS (SELECT oc.*, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 0.5 THEN 'up' WHEN z < -0.5 THEN 'down' ELSE 'range' END AS regime FROM oc JOIN (SELECT symbol, idx, CASE WHEN atr > 0 AND count(c) OVER {win(50)} = 50 THEN (c - avg(c) OVER {win(50)}) / atr END AS z FROM rw) q USING (symbol, idx)) SELECT regime, count(r_net) AS n, {sr('avg(r_net)', 5)} AS ev, {sr('avg((r_net > 0)::INT)')} AS win_rate FROM rg WHERE goal = 2 AND execution = 'market' GROUP BY 1")
def regime_stats(spark, d):
    g = panel(spark, d).filter(_P3).groupBy("regime").agg(F.count("r_net").alias("n"), F.avg("r_net").alias("ev"), F.avg((c("r_net") > 0).cast("double")).alias("win_rate"))
    return g.select("regime", "n", r6("ev", 5).alias("ev"), r6("win_rate").alias("win_rate"))


_RG = _PN + f", rg AS (SELECT oc.*, CASE WHEN is_long THEN 'long' ELSE 'short' END AS side, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 0.5 THEN 'up' WHEN z < -0.5 THEN 'down' ELSE 'range' END AS regime FROM oc JOIN (SELECT symbol, idx, CASE WHEN atr > 0 AND count(c) OVER {win(50)} = 50 THEN (c - avg(c) OVER {win(50)}) / atr END AS z FROM rw) q USING (symbol, idx) WHERE goal = 2 AND execution = 'market' AND r_net IS NOT NULL), rs AS (SELECT regime, side, rule, count(*) AS n, avg(r_net) AS ev FROM rg GROUP BY ALL), tb AS (SELECT regime, side, CASE WHEN max(ev) > 0 AND arg_max(n, (ev, rule)) >= 30 THEN arg_max(rule, (ev, rule)) ELSE 'zone:1.0' END AS rule FROM rs GROUP BY 1, 2)"


@query("rule_table", _RG + " SELECT regime, side, rule FROM tb")
def rule_table(spark, d):
    return X.pick_rules(panel(spark, d).filter("target_r = 2.0 and execution = 'market'"), 30)


@query("rule_table_applied", _RG + f" SELECT regime, side, count(r_net) AS n, {sr('avg(r_net)', 5)} AS ev FROM rg SEMI JOIN tb USING (regime, side, rule) GROUP BY 1, 2")
def rule_table_applied(spark, d):
    p = panel(spark, d).filter("target_r = 2.0 and execution = 'market'")
    a = X.apply_rules(p, X.pick_rules(p, 30))
    return a.groupBy("regime", "side").agg(F.count("r_net").alias("n"), r6(F.avg("r_net"), 5).alias("ev"))


@query("policy_values", _PN + f", k AS (SELECT symbol, idx, is_long, max(r_net) AS best, avg(r_net) AS av, max(CASE WHEN rule = 'zone:1.0' THEN r_net END) AS fx FROM oc WHERE goal = 2 AND execution = 'market' AND r_net IS NOT NULL GROUP BY ALL) SELECT count(*) AS n, {sr('avg(best)', 5)} AS oracle_ev, {sr('avg(av)', 5)} AS random_ev, {sr('avg(fx)', 5)} AS fixed_ev FROM k")
def policy_values(spark, d):
    v = X.policy_values(panel(spark, d).filter(_P3), ["symbol", "idx", "is_long"], "risk_unit", fixed="zone:1.0")
    return v.select("n", r6("oracle_ev", 5).alias("oracle_ev"), r6("random_ev", 5).alias("random_ev"), r6("fixed_ev", 5).alias("fixed_ev"))


@query("score_flips")
def score_flips(spark, d):
    p = panel(spark, d).filter("r_net is not null").withColumn("score", c("risk_unit") / c("atr"))
    noise = (P.hashed(F.lit(5), c("idx"), F.hash("rule")) % 1000 - 500) * 1e-9
    return X.score_flips(p, ["symbol", "idx", "is_long"], "score", noise)


@query("cost_cap_grid", _PN + f", q AS (SELECT unnest([0.005, 0.01, 0.05])::DOUBLE AS cap) SELECT cap, count(r_net) AS n, {sr('avg(r_net)', 5)} AS ev FROM oc, q WHERE 0.0025 * fill / abs(fill - stop) <= cap AND goal = 2 AND execution = 'market' GROUP BY cap")
def cost_cap_grid(spark, d):
    p = panel(spark, d).filter(_P3).withColumn("cost", PN.cost_in_r()).withColumn("cap", F.explode(F.array(F.lit(0.005), F.lit(0.01), F.lit(0.05)))).filter("cost <= cap")
    return p.groupBy("cap").agg(F.count("r_net").alias("n"), r6(F.avg("r_net"), 5).alias("ev"))


@query("relevance_grades", f"WITH {B} SELECT symbol, idx, greatest(0, least(12, round_even((c / 50 + 2) * 2, 0)::INT)) AS grade FROM b")
def relevance_grades(spark, d):
    return T.bars(spark, d).select("symbol", "idx", PN.relevance(c("close") / 50).alias("grade"))


@query("policy_replay")
def policy_replay(spark, d):
    p = panel(spark, d).filter("target_r = 2.0 and execution = 'market' and r_net is not null").withColumn("score", c("risk_unit") / c("atr"))
    return PN.replay(p, rows(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("r_pess"), 5).alias("total"))


@query("strategy_labels")
def strategy_labels(spark, d):
    """Entries where the bar's extreme lies in a live zone that has been broken before, one trade at a time."""
    e = cands(spark, d).withColumns({"tp": c("close") + O.sign() * 2 * c("atr"), "sl": c("close") - O.sign() * 1.5 * c("atr")}).filter(PN.reward_ok())
    one = e.groupBy("symbol", "idx").agg(F.min_by(F.struct("is_long", "tp", "sl"), "side").alias("_e")).select("symbol", "idx", "_e.*")
    return PN.strategy_labels(one, rows(spark, d)).select("symbol", "idx", "action", r6("outcome", 5).alias("outcome"))


@query("placebo_zones", f"WITH {_SW} SELECT symbol, block_id, {sr(f'''zone_low + CASE WHEN block_type = 'demand' THEN -1 ELSE 1 END * (0.5 + {hash_sql('9', 'block_id')} % 1000 / 1000.0) * atr''')} AS zone_low FROM ob")
def placebo_zones(spark, d):
    """Zones moved away from price by a hashed number of ATRs."""
    a = rows(spark, d).select("symbol", "idx", "atr")
    b = blocks(spark, d).join(a, ["symbol", "idx"])
    out = F.when(c("block_type") == "demand", -1).otherwise(1) * (0.5 + P.hashed(F.lit(9), c("block_id")) % 1000 / 1000.0) * c("atr")
    return b.select("symbol", "block_id", r6(c("zone_low") + out).alias("zone_low"))


@query("label_permutation", f"""WITH {B}, a AS (SELECT symbol, idx, c FROM b), p AS (SELECT symbol, c, row_number() OVER (PARTITION BY symbol ORDER BY {hash_sql('13', 'idx')}, idx) - 1 AS idx FROM b) SELECT a.symbol, {sr('corr(a.c, p.c)', 5)} AS rho FROM a JOIN p USING (symbol, idx) GROUP BY 1""")
def label_permutation(spark, d):
    """Labels dealt out again in the order of a hash."""
    a = T.bars(spark, d).select("symbol", "idx", "close")
    h = a.withColumn("_h", P.hashed(F.lit(13), c("idx")).cast("double")).withColumnRenamed("idx", "_i")
    p = ordinals(h, ["symbol"], ["_h", "_i"]).select("symbol", "idx", c("close").alias("other"))
    return a.join(p, ["symbol", "idx"]).groupBy("symbol").agg(r6(F.corr("close", "other"), 5).alias("rho"))


@query("volume_control_arm", Sql().add(v1="1.0::DOUBLE").add(pv="c * v1").add(y=div(avg("pv", 10), avg("v1", 10))).out("y"))
def volume_control_arm(spark, d):
    f = Frame.of_numbered(T.bars(spark, d).withColumn("volume", F.lit(1.0)), 12)
    return rounded(V.vwma(f).add(y=c("vwma")).core(), ["symbol", "idx"], ["y"])


@query("adaptive_target", "WITH " + EV + f""", y AS (SELECT e.symbol, e.idx, e.close, e.risk, e.sg, e.is_long, 1 + e.idx % 3 AS goal, s.idx AS j, s.h, s.l, s.c AS jc FROM ev e LEFT JOIN s ON s.symbol = e.symbol AND s.idx > e.idx AND s.idx <= e.idx + 24),
q AS (SELECT symbol, idx, any_value(goal) AS goal, min(CASE WHEN (is_long AND l <= close - risk) OR (NOT is_long AND h >= close + risk) THEN j * 2 WHEN (is_long AND h >= close + goal * risk) OR (NOT is_long AND l <= close - goal * risk) THEN j * 2 + 1 END) AS code, arg_max(jc, j) AS lc, any_value(close) AS close, any_value(risk) AS risk, any_value(sg) AS sg FROM y GROUP BY 1, 2)
SELECT symbol, idx, {sr('CASE WHEN code IS NULL THEN sg * (coalesce(lc, close) - close) / risk WHEN code % 2 = 0 THEN -1 ELSE goal END')} AS gross FROM q""")
def adaptive_target(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule())
    return rounded(O.r_exit(ev, T.bars(spark, d), ["symbol", "idx"], 1 + c("idx") % 3, 24), ["symbol", "idx"], ["gross"])


# -- models ------------------------------------------------------------------
def _learn(spark, d):
    f = features(spark, d).filter("z is not null and slope is not null")
    nxt = T.bars(spark, d).select("symbol", (c("idx") - 6).alias("idx"), c("close").alias("_f"))
    return f.join(nxt, ["symbol", "idx"]).select("symbol", "idx", "ts", "z", "slope", (c("_f") / c("close") - 1).alias("y"), (c("_f") > c("close")).cast("int").alias("win"))


@query("logistic_scores")
def logistic_scores(spark, d):
    t = _learn(spark, d)
    m = ML.logistic(t, ["z", "slope"])
    return m.transform(t).select("symbol", "idx", r6(ML.margin(), 4).alias("margin"))


@query("boosted_scores")
def boosted_scores(spark, d):
    t = _learn(spark, d)
    m = ML.boosted(t, ["z", "slope"], "win", trees=5)
    return m.transform(t).select("symbol", "idx", "prediction")


@query("isotonic_brier")
def isotonic_brier(spark, d):
    t = _learn(spark, d)
    iso = ML.calibrate(t, "z", "win")
    p = iso.transform(t.withColumn("features", c("z")))
    return ML.brier(p, c("prediction"), c("win")).select("n", r6("brier", 4).alias("brier"), r6("base_brier", 4).alias("base_brier"))


@query("blended_scores", f"""WITH {B}, r AS (SELECT symbol, idx, (row_number() OVER (ORDER BY c, symbol, idx) - 1) / (count(*) OVER () - 1)::DOUBLE AS a, (row_number() OVER (ORDER BY v, symbol, idx) - 1) / (count(*) OVER () - 1)::DOUBLE AS z FROM b) SELECT symbol, idx, {sr('0.75 * a + 0.25 * z')} AS score FROM r""")
def blended_scores(spark, d):
    b = T.bars(spark, d).select("symbol", "idx", "close", "volume")
    return rounded(ML.blend(b, ["close", "volume"], "weighted", {"close": 3.0, "volume": 1.0}, ["symbol", "idx"]), ["symbol", "idx"], ["score"])


@query("out_of_fold_scores")
def out_of_fold_scores(spark, d):
    t = _learn(spark, d)
    return ML.out_of_fold(t, lambda tr: ML.logistic(tr, ["z", "slope"]), 3, ML.margin()).select("symbol", "idx", r6("oof", 4).alias("oof"))


# -- factors -----------------------------------------------------------------
def returns(spark, d):
    """Weekly log returns of brands on weeks where all are present."""
    def build():
        f = Frame.of_numbered(T.brands(spark, d), 1)
        f = f.add(r=F.log(c("close") / f.lag(c("close"))))
        return common_buckets(f.core("symbol", "ts", "r").filter("r is not null"), "ts")

    return stored(spark, "brand_returns", d, build)


_RET = f"""WITH {BR}, r0 AS (SELECT symbol, ts, ln(c / {lag('c')}) AS r FROM b), r AS MATERIALIZED (SELECT * FROM r0 WHERE r IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) = (SELECT count(DISTINCT symbol) FROM b))"""


def _power_sql(corr: str, keys: str = "", steps: int = 12) -> str:
    """First eigenvectors by squaring ``corr`` (keys, i, j, v) again and again: ``pw`` (keys, i, w), of length one."""
    k, on = (f"{keys}, ", f" AND a.{keys} = z.{keys}") if keys else ("", "")
    ka = f"a.{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""sq AS (SELECT 0 AS k, {k}i, j, v FROM {corr} UNION ALL
 SELECT k + 1, {k}i, j, v / sum(CASE WHEN i = j THEN v END) OVER ({part}) FROM (SELECT a.k, {ka}a.i, z.j, sum(a.v * z.v) AS v FROM sq a JOIN sq z ON a.j = z.i{on} WHERE a.k < {steps} GROUP BY ALL)),
 lq AS MATERIALIZED (SELECT * FROM sq WHERE k = {steps}), cl AS (SELECT {k}arg_max(i, v) AS j FROM lq WHERE i = j {f"GROUP BY {keys}" if keys else ""}),
 p0 AS (SELECT {k.replace(keys, "lq." + keys) if keys else ""}lq.i, lq.v FROM lq JOIN cl ON lq.j = cl.j{f" AND lq.{keys} = cl.{keys}" if keys else ""}),
 pw AS MATERIALIZED (SELECT {k}i, v / sqrt(sum(v * v) OVER ({part})) AS w FROM p0)"""


_CM = _RET.replace("WITH ", "WITH RECURSIVE ", 1) + """, cm AS MATERIALIZED (SELECT a.symbol AS i, z.symbol AS j, corr(a.r, z.r) AS v FROM r a JOIN r z USING (ts) GROUP BY 1, 2), """ + _power_sql("cm")


@query("factor_spectrum", _CM + """, n AS (SELECT count(DISTINCT symbol) AS p, count(DISTINCT ts) AS n_obs FROM r), e AS (SELECT (1 + sqrt(p / n_obs)) ** 2 AS edge FROM n),
rk AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS q FROM (SELECT DISTINCT symbol FROM r)),
m0 AS (SELECT x.q AS i, y.q AS j, v - CASE WHEN x.q = y.q THEN edge ELSE 0 END AS v FROM cm JOIN rk x ON x.symbol = cm.i JOIN rk y ON y.symbol = cm.j, e),
pv AS (SELECT 0 AS k, i, j, v FROM m0 UNION ALL SELECT a.k + 1, a.i, a.j, a.v - b.v * d.v / g.v FROM pv a JOIN pv b ON b.i = a.i AND b.j = a.k JOIN pv d ON d.i = a.k AND d.j = a.j JOIN pv g ON g.i = a.k AND g.j = a.k WHERE a.i > a.k AND a.j > a.k),
l1 AS (SELECT sum(x.w * cm.v * y.w) AS lam FROM cm JOIN pw x ON x.i = cm.i JOIN pw y ON y.i = cm.j)
SELECT p, n_obs, """ + f"{sr('lam / p', 5)} AS pc1_share, (SELECT count(*) FROM pv WHERE i = k AND j = k AND v > 0) AS n_factors, {sr('(SELECT avg(v) FROM cm WHERE i <> j)', 5)} AS mean_corr FROM n, l1")
def factor_spectrum(spark, d):
    s = SP.spectrum(returns(spark, d), "ts", "symbol", "r")
    return s.select(c("p").cast("long").alias("p"), c("n_obs").cast("long").alias("n_obs"), r6("pc1_share", 5).alias("pc1_share"), c("n_factors").cast("long").alias("n_factors"), r6("mean_corr", 5).alias("mean_corr"))


@query("first_factor_weights", _CM + f" SELECT i AS asset, {sr('w * sign(sum(w) OVER ())', 4)} AS w FROM pw")
def first_factor_weights(spark, d):
    return rounded(SP.first_weights(returns(spark, d), "ts", "symbol", "r"), ["asset"], ["w"], 4)


@query("factor_closeness", _CM + f", sc AS (SELECT ts, sum(w * r) AS s FROM r JOIN pw ON pw.i = r.symbol GROUP BY 1) SELECT symbol AS asset, {sr('abs(corr(r, s))', 5)} AS closeness FROM r JOIN sc USING (ts) GROUP BY 1")
def factor_closeness(spark, d):
    return rounded(SP.factor_closeness(returns(spark, d), "ts", "symbol", "r"), ["asset"], ["closeness"], 5)


def _numbered_returns(spark, d):
    """Weekly returns of brands on the numbered weeks on which all have one."""
    r = returns(spark, d)
    return r.join(number_bars(r.select("ts").distinct().withColumn("book", F.lit("x")), WEEK_MS, key="book").select("ts", "idx"), "ts").select("idx", "symbol", "r")


_RB = _RET.replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY ts) - 1 AS s, symbol, r FROM r), tt AS MATERIALIZED (SELECT unnest(range(72, (SELECT max(s) + 1 FROM x) - 12, 12)) AS t),
cm AS MATERIALIZED (SELECT t, a.symbol AS i, z.symbol AS j, corr(a.r, z.r) AS v FROM tt JOIN x a ON a.s BETWEEN t - 48 AND t - 1 JOIN x z ON z.s = a.s GROUP BY ALL), """ + _power_sql("cm", "t") + """,
bt AS (SELECT t, i, w * sign(arg_max(w, abs(w)) OVER (PARTITION BY t)) AS b FROM pw), sm AS (SELECT t, symbol AS i, sum(r) AS q FROM tt JOIN x ON s BETWEEN t - 23 AND t GROUP BY ALL),
sg AS (SELECT t, i, q - b * sum(b * q) OVER (PARTITION BY t) AS g FROM sm JOIN bt USING (t, i)), od AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY g, i) AS lo, row_number() OVER (PARTITION BY t ORDER BY g DESC, i DESC) AS hi FROM sg),
fw AS (SELECT t, symbol AS i, sum(r) AS f FROM tt JOIN x ON s BETWEEN t + 1 AND t + 12 GROUP BY ALL), o AS (SELECT t, sum(CASE WHEN lo <= 3 THEN f ELSE 0 END - CASE WHEN hi <= 3 THEN f ELSE 0 END) / 3 AS gross FROM od JOIN fw USING (t, i) GROUP BY t)"""


@query("factor_residual_book", _RB + f" SELECT t, {sr('gross', 5)} AS gross, {sr('gross - 0.002', 5)} AS net FROM o")
def factor_residual_book(spark, d):
    return rounded(SP.residual_book(_numbered_returns(spark, d), 48, 24, 3, 12), ["t"], ["gross", "net"], 5)


_SD = f"""WITH RECURSIVE {B}, x AS MATERIALIZED (SELECT * FROM (SELECT symbol, idx, ln(c / {lag('c')}) AS r FROM b) WHERE r IS NOT NULL), tt AS MATERIALIZED (SELECT DISTINCT idx AS t FROM x),
wn AS MATERIALIZED (SELECT t, symbol, idx, r FROM tt JOIN x ON idx BETWEEN t - 48 AND t - 1), ok AS (SELECT t, symbol FROM wn GROUP BY ALL HAVING count(*) = 48 AND stddev_pop(r) > 0), us AS MATERIALIZED (SELECT wn.* FROM wn JOIN ok USING (t, symbol)),
cm AS MATERIALIZED (SELECT t, a.symbol AS i, z.symbol AS j, corr(a.r, z.r) AS v FROM us a JOIN us z USING (t, idx) GROUP BY ALL), """


@query("factor_share_deciles", _SD + _power_sql("cm", "t", 14) + """, sh AS MATERIALIZED (SELECT cm.t, sum(x.w * cm.v * y.w) / sqrt(count(*)) AS share FROM cm JOIN pw x ON x.t = cm.t AND x.i = cm.i JOIN pw y ON y.t = cm.t AND y.i = cm.j GROUP BY cm.t HAVING count(*) > 1),
 qt AS (SELECT unnest(quantile_cont(share, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM sh), pn AS (SELECT idx AS t, sum(ln(c / o)) AS pnl FROM b GROUP BY 1), dc AS (SELECT sh.t, share, 1 + count_if(q <= share) AS decile FROM sh, qt GROUP BY ALL)
SELECT decile::BIGINT AS decile, count(*) AS n, """ + f"{sr('min(share)', 5)} AS low, {sr('max(share)', 5)} AS high, {sr('avg(coalesce(pnl, 0))', 5)} AS mean_pnl, {sr('sum(coalesce(pnl, 0))', 5)} AS sum_pnl FROM dc LEFT JOIN pn USING (t) GROUP BY 1")
def factor_share_deciles(spark, d):
    """Profit of an equal book that holds every symbol from open to close, by decile of the first factor's share."""
    f = Frame.of_numbered(T.bars(spark, d), 1)
    panel = f.add(r=F.log(c("close") / f.lag(c("close")))).core("symbol", "idx", "r")
    out = SP.share_deciles(panel, T.bars(spark, d).select("idx", F.log(c("close") / c("open")).alias("r")), 48)
    return rounded(out.withColumn("decile", c("decile").cast("long")), ["decile", "n"], ["low", "high", "mean_pnl", "sum_pnl"], 5)


@query("tail_correlation", _RET + f""", m AS (SELECT ts, avg(r) AS m FROM r GROUP BY 1), q AS (SELECT quantile_cont(m, 0.2) AS q FROM m), t AS (SELECT r.* FROM r JOIN m USING (ts), q WHERE m <= q), p AS (SELECT a.symbol AS a, z.symbol AS z, corr(a.r, z.r) AS rho FROM t a JOIN t z USING (ts) WHERE a.symbol <> z.symbol GROUP BY 1, 2) SELECT {sr('avg(rho)', 4)} AS mean_corr FROM p""")
def tail_correlation(spark, d):
    t = FA.tail_rows(returns(spark, d), "ts", "r", 0.2)
    rho = SP.correlations(t, "ts", "symbol", "r", fill=None).filter("a != b")
    return rho.agg(r6(F.avg("rho"), 4).alias("mean_corr"))


@query("factor_distance", _RET + f", m AS (SELECT ts, avg(r) AS m FROM r GROUP BY 1) SELECT symbol, {sr('1 - abs(corr(r, m))')} AS distance FROM r JOIN m USING (ts) GROUP BY 1")
def factor_distance(spark, d):
    return rounded(FA.factor_distance(returns(spark, d), "ts", "symbol", "r"), ["symbol"], ["distance"])


@query("rolling_factor_share")
def rolling_factor_share(spark, d):
    r = returns(spark, d)
    day = number_bars(r.select("ts").distinct().withColumn("book", F.lit("x")), WEEK_MS, key="book").select("ts", "idx")
    return FA.rolling_share(r.join(day, "ts"), 60, 20).select("end", "n_assets", r6("share", 4).alias("share"))


@query("spearman_streams", f"WITH {B}, r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY c) + (count(*) OVER (PARTITION BY symbol, c) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY h - l) + (count(*) OVER (PARTITION BY symbol, h - l) - 1) / 2.0 AS z FROM b) SELECT symbol, {sr('corr(a, z)', 5)} AS rho FROM r GROUP BY 1")
def spearman_streams(spark, d):
    """Pearson on average ranks: ordinals from range partitions, averaged over equal values."""
    b = T.bars(spark, d).select("symbol", c("idx").alias("_i"), c("close").alias("a"), (c("high") - c("low")).alias("z"))
    out = b
    for x in ("a", "z"):
        ranks = ordinals(b.select("symbol", "_i", x), ["symbol"], [x, "_i"], "_r")
        out = out.join(ranks.groupBy("symbol", x).agg((F.avg("_r") + 1).alias(f"r{x}")), ["symbol", x])
    return out.groupBy("symbol").agg(r6(F.corr("ra", "rz"), 5).alias("rho"))


@query("below_long_average", Sql().add(a=avg("c", 100)).text("SELECT symbol, idx, coalesce(c < a, false) AS below FROM $"))
def below_long_average(spark, d):
    return FA.below_average(Frame.of_numbered(T.bars(spark, d), 102), 100).core("symbol", "idx", "below")


@query("vol_regime", Sql().add(lr=f"ln(c / {lag('c')})").add(rv=full("stddev_pop(lr)", "lr", 30)).add(md=full("median(rv)", "rv", 60)).text("SELECT symbol, idx, CASE WHEN rv > md THEN 0.5 ELSE 1.0 END::DOUBLE AS mult FROM $"))
def vol_regime(spark, d):
    return FA.vol_regime(Frame.of_numbered(T.bars(spark, d), 92), 30, 60).core("symbol", "idx", "mult")


@query("fractal_structure", Sql().add(h1=lag("h", 1), h2=lag("h", 2), h3=lag("h", 3), h4=lag("h", 4), l1=lag("l", 1), l2=lag("l", 2), l3=lag("l", 3), l4=lag("l", 4)).add(
    kh="CASE WHEN h2 > h3 AND h2 > h4 AND h2 > h1 AND h2 > h THEN h2 END", kl="CASE WHEN l2 < l3 AND l2 < l4 AND l2 < l1 AND l2 < l THEN l2 END").add(
    wh=f"list(kh) FILTER (WHERE kh IS NOT NULL) OVER {ORD}", wl=f"list(kl) FILTER (WHERE kl IS NOT NULL) OVER {ORD}").text(
    "SELECT symbol, idx, CASE WHEN len(wh) >= 2 AND len(wl) >= 2 AND wh[-1] > wh[-2] AND wl[-1] > wl[-2] THEN 1 WHEN len(wh) >= 2 AND len(wl) >= 2 AND wh[-1] < wh[-2] AND wl[-1] < wl[-2] THEN -1 ELSE 0 END AS structure FROM $"))
def fractal_structure(spark, d):
    return FA.fractal_structure(Frame.of_numbered(T.bars(spark, d), 8, 2)).core("symbol", "idx", "structure")


@query("half_life", Sql().add(p=lag("c")).text(f"SELECT symbol, {sr('regr_slope(c, p)')} AS b, {sr('CASE WHEN regr_slope(c, p) > 0 AND regr_slope(c, p) < 1 THEN -ln(2) / ln(regr_slope(c, p)) END')} AS half_life FROM $ WHERE p IS NOT NULL GROUP BY 1"))
def half_life(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 1)
    return rounded(FA.half_life(f.add(p=f.lag(c("close"))).core(), "close", "p", ["symbol"]), ["symbol"], ["b", "half_life"])


@query("funding_persistence", Sql().add(p=lag("c")).text(f"SELECT symbol, {sr('corr(c, p)')} AS rho FROM $ WHERE p IS NOT NULL GROUP BY 1"))
def funding_persistence(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 1)
    return f.add(p=f.lag(c("close"))).core().filter("p is not null").groupBy("symbol").agg(r6(F.corr("close", "p")).alias("rho"))


@query("long_factor_return", Sql().add(f=f"ln(c / {lag('c', 48)})").out("f"))
def long_factor_return(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 48)
    return rounded(f.add(f=F.log(c("close") / f.lag(c("close"), 48))).core(), ["symbol", "idx"], ["f"])


@query("negative_windows", Sql().add(s=f"sum(c - 40) OVER {ORD}").add(q=lag("s", 168)).text("SELECT symbol, count_if(s - q < 0)::BIGINT AS negative, count(q) AS n FROM $ GROUP BY 1"))
def negative_windows(spark, d):
    from ..operators.running import running

    f = running(Frame.of_numbered(T.bars(spark, d), 168), s=("sum", c("close") - 40)).settle()
    f = f.add(q=f.lag(c("s"), 168))
    return f.core().groupBy("symbol").agg(F.count_if(c("s") - c("q") < 0).alias("negative"), F.count("q").alias("n"))


@query("svd_denoise")
def svd_denoise(spark, d):
    return rounded(FA.denoise(Frame.of_numbered(T.bars(spark, d), 30), 30, 3).core(), ["symbol", "idx"], ["smooth"], 5)


# -- carry -------------------------------------------------------------------
@query("slow_carry", Sql().add(rate="(c - 40) / 1000").add(sgn=full("avg(rate)", "rate", 3, 1)).loop("pos", "0", "CASE WHEN n.sgn IS NULL THEN p.pos WHEN p.pos = 0 AND n.sgn > 0.01 THEN 1 WHEN p.pos = 1 AND n.sgn < 0 THEN 0 ELSE p.pos END").add(pp=f"coalesce({lag('pos')}, 0)").text(
    f"SELECT symbol, idx, pos, {sr('pos * rate - 0.001 * abs(pos - pp)')} AS r FROM $"))
def slow_carry(spark, d):
    f = FA.trailing_signal(Frame.of_numbered(T.bars(spark, d).withColumn("rate", (c("close") - 40) / 1000), 4))
    return FA.slow_carry(f.core("symbol", "idx", "rate", "signal"), 0.01, 0.0, 0.001).select("symbol", "idx", "pos", r6("r").alias("r"))


@query("two_sided_carry", Sql().add(rate="CASE WHEN idx % 17 <> 3 THEN (c - 40) / 1000 END").add(sgn=full("avg(coalesce(rate, 0))", "c", 3, 1)).loop("pos", "0", "CASE WHEN n.rate IS NULL THEN p.pos WHEN p.pos = 0 AND n.sgn >= 0.01 THEN -1 WHEN p.pos = 0 AND n.sgn <= -0.01 THEN 1 WHEN p.pos = -1 AND n.sgn <= 0 THEN 0 WHEN p.pos = 1 AND n.sgn >= 0 THEN 0 ELSE p.pos END").add(pp=f"coalesce({lag('pos')}, 0)").text(
    f"SELECT symbol, idx, pos::INTEGER AS pos, {sr('CASE WHEN rate IS NULL THEN 0 ELSE -pos * rate - CASE WHEN pos <> pp THEN 0.001 ELSE 0 END END')} AS r FROM $"))
def two_sided_carry(spark, d):
    return _two_sided(spark, d).select("symbol", "idx", "pos", r6("r").alias("r"))


def _two_sided(spark, d):
    """Every seventeenth bar lacks a rate."""
    f = Frame.of_numbered(T.bars(spark, d).withColumn("rate", F.when(c("idx") % 17 != 3, (c("close") - 40) / 1000)), 4)
    f = f.add(signal=f.full(F.avg(F.coalesce("rate", F.lit(0.0))), c("close"), 3, 1))
    return FA.two_sided_carry(f.core("symbol", "idx", "rate", "signal"), 0.01)


@query("carry_interval", Sql().add(rate="CASE WHEN idx % 17 <> 3 THEN (c - 40) / 1000 END").add(sgn=full("avg(coalesce(rate, 0))", "c", 3, 1)).loop("pos", "0", "CASE WHEN n.rate IS NULL THEN p.pos WHEN p.pos = 0 AND n.sgn >= 0.01 THEN -1 WHEN p.pos = 0 AND n.sgn <= -0.01 THEN 1 WHEN p.pos = -1 AND n.sgn <= 0 THEN 0 WHEN p.pos = 1 AND n.sgn >= 0 THEN 0 ELSE p.pos END").add(pp=f"coalesce({lag('pos')}, 0)").add(
    r="CASE WHEN rate IS NULL THEN 0 ELSE -pos * rate - CASE WHEN pos <> pp THEN 0.001 ELSE 0 END END").add(s=f"sum(r) OVER {ORD}").text(
    f"""SELECT book, n::BIGINT AS n, {sr('any_value(tot) / any_value(n) * 36500', 4)} AS annual, {sr('quantile_cont(m, 0.025) * 36500', 4)} AS lo, {sr('quantile_cont(m, 0.975) * 36500', 4)} AS hi FROM (
 SELECT p.symbol AS book, rep, n, any_value(tot) AS tot, sum(z.s - coalesce(y.s, 0)) / any_value(n) AS m FROM (SELECT *, a + least(30, n - j * 30) AS e FROM (SELECT symbol, n, tot, rep, j, ({hash_sql('7', 'rep', 'j')} % (n - 30 + 1)) AS a FROM (SELECT symbol, max(idx) + 1 AS n, arg_max(s, idx) AS tot FROM $ GROUP BY 1) q, (SELECT unnest(range(0, 200))::BIGINT AS rep) w, (SELECT unnest(range(0, 2000))::BIGINT AS j) v WHERE j < ceil(n / 30.0))) p
 LEFT JOIN $ y ON y.symbol = p.symbol AND y.idx = a - 1 JOIN $ z ON z.symbol = p.symbol AND z.idx = e - 1 GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def carry_interval(spark, d):
    s = _two_sided(spark, d).select(c("symbol").alias("book"), "idx", "r")
    return rounded(IN.annual_interval(s, 30, 200), ["book", "n"], ["annual", "lo", "hi"], 4)


@query("random_fills")
def random_fills(spark, d):
    b = T.bars(spark, d).withColumns({"want": (c("close") > c("open")).cast("double"), "u": (P.hashed(F.lit(21), c("idx")) % 10_000) / 10_000.0})
    return FA.random_fills(b).select("symbol", "idx", "want", "held")


@query("next_day_mapping", f"""WITH {B}, g AS (SELECT symbol, ts // 86400000 + 1 AS day, sum(c) AS f FROM b GROUP BY 1, 2) SELECT b.symbol, b.idx, {sr('coalesce(g.f, 0)')} AS f FROM b LEFT JOIN g ON g.symbol = b.symbol AND g.day = b.ts // 86400000""")
def next_day_mapping(spark, d):
    b = T.bars(spark, d).withColumn("day", F.floor(c("ts") / DAY_MS))
    g = b.groupBy("symbol", (c("day") + 1).alias("day")).agg(F.sum("close").alias("f"))
    return b.join(g, ["symbol", "day"], "left").select("symbol", "idx", r6(F.coalesce("f", F.lit(0.0))).alias("f"))


@query("size_terciles", f"""SELECT year(l_shipdate)::INTEGER AS year, CASE WHEN q <= a THEN 1 WHEN q <= z THEN 2 ELSE 3 END AS tercile, count(*) AS n FROM (SELECT l_shipdate, l_quantity AS q, year(l_shipdate) AS y FROM lineitem) x
 JOIN (SELECT year(l_shipdate) AS y, quantile_cont(l_quantity, 1.0 / 3) AS a, quantile_cont(l_quantity, 2.0 / 3) AS z FROM lineitem GROUP BY 1) c USING (y) GROUP BY 1, 2""")
def size_terciles(spark, d):
    li = T.table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity")
    return X.terciles(li, ["year"], "l_quantity").groupBy("year", "tercile").agg(F.count(F.lit(1)).alias("n"))


@query("rolling_dollar_volume", Sql().add(dv="c * v").add(y=full("median(dv)", "dv", 60)).out("y"))
def rolling_dollar_volume(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 60)
    f = f.add(dv=c("close") * c("volume"))
    return rounded(f.add(y=f.full(F.percentile("dv", 0.5), c("dv"), 60)).core(), ["symbol", "idx"], ["y"])


@query("calendar_grid", f"WITH b AS ({USERS_SQL}), t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS day FROM (SELECT DISTINCT ts FROM b)) SELECT b.symbol, b.idx, t.day, t.day - b.idx AS offset_days FROM b JOIN t USING (ts)")
def calendar_grid(spark, d):
    b = T.users(spark, d)
    days = number_bars(b.select("ts").distinct().withColumn("book", F.lit("x")), DAY_MS, key="book").select("ts", c("idx").alias("day"))
    return b.join(days, "ts").select("symbol", "idx", "day", (c("day") - c("idx")).alias("offset_days"))


@query("filter_gate", _FE.text("SELECT symbol, idx, coalesce(z > 0 AND slope > 0, false) AS allowed FROM $"))
def filter_gate(spark, d):
    """Two trend filters a long entry must pass together."""
    return features(spark, d).select("symbol", "idx", G.true((c("z") > 0) & (c("slope") > 0)).alias("allowed"))


# -- options -----------------------------------------------------------------
@query("nearest_strike", """WITH w AS (SELECT DISTINCT epoch_ms(o_orderdate) // 86400000 AS day FROM orders WHERE o_orderkey % 7 = 0), x AS (SELECT o_orderkey, day, 3 + o_orderkey % 5 AS need, 100.0 + o_orderkey % 50 AS spot FROM (SELECT o_orderkey, epoch_ms(o_orderdate) // 86400000 AS day FROM orders)),
ch AS (SELECT DISTINCT epoch_ms(l_shipdate) // 86400000 AS day, l_linenumber AS expiry, (60 + l_quantity)::DOUBLE AS strike FROM lineitem), j AS (SELECT x.*, expiry, strike FROM x JOIN ch USING (day) WHERE expiry >= need),
f AS (SELECT o_orderkey, min(expiry) AS expiry FROM j GROUP BY 1) SELECT day, need, spot::DOUBLE AS spot, expiry, strike FROM (SELECT DISTINCT day, need, spot, j.expiry, arg_min(strike, (abs(strike - 0.9 * spot), strike)) OVER (PARTITION BY j.o_orderkey) AS strike FROM j JOIN f ON f.o_orderkey = j.o_orderkey AND f.expiry = j.expiry)""")
def nearest_strike(spark, d):
    day = lambda x: F.floor(T.epoch_ms(c(x)) / DAY_MS)
    want = T.table(spark, d, "orders").select(day("o_orderdate").alias("day"), (3 + c("o_orderkey") % 5).alias("need"), (100.0 + c("o_orderkey") % 50).alias("spot")).distinct()
    chain = T.table(spark, d, "lineitem").select(day("l_shipdate").alias("day"), c("l_linenumber").alias("expiry"), (60 + c("l_quantity")).cast("double").alias("strike")).distinct()
    return FA.nearest_strike(want, chain)


def _phi_sql(x: str) -> str:
    def polynomial(factors):
        out = f"{factors[0]!r}::DOUBLE"
        for f in factors[1:]:
            out = f"({out} * abs({x}) + {f!r}::DOUBLE)"
        return out

    far = f"(abs({x}) + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"(abs({x}) + {k}::DOUBLE / {far})"
    tail = f"exp(-abs({x}) * abs({x}) / 2) * CASE WHEN abs({x}) < {FA.PHI_FAR}::DOUBLE THEN {polynomial(FA.PHI_TOP)} / {polynomial(FA.PHI_BOTTOM)} ELSE 1 / ({far} * {FA.PHI_ROOT}::DOUBLE) END"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


@query("option_values", f"""WITH {B}, v AS (SELECT symbol, idx, c AS s, 0.9::DOUBLE * c AS k, 0.6::DOUBLE * sqrt(30::DOUBLE / 365) AS sd FROM b), w AS (SELECT *, CASE WHEN s > 0 THEN ln(s / k) / sd + sd / 2 END AS d1 FROM v), x AS (SELECT *, sd - d1 AS p, -d1 AS q FROM w)
SELECT symbol, idx, {sr(f"CASE WHEN s <= 0 THEN greatest(k - s, 0) ELSE k * ({_phi_sql('p')}) - s * ({_phi_sql('q')}) END")} AS put FROM x""")
def option_values(spark, d):
    return T.bars(spark, d).select("symbol", "idx", r6(FA.put_value(c("close"), 0.9 * c("close"), F.lit(30 / 365), F.lit(0.6))).alias("put"))


# -- streaming ---------------------------------------------------------------
def _run_stream(spark, df, schema_of, mode="append"):
    """Drain a bounded stream into a table of the shared folder and read it back."""
    base = f"{shared_dir(spark)}/ohlcraft/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema_of.schema).parquet(f"{base}/out")


def _event_stream(spark, d):
    static = T.table(spark, d, "events")
    s = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"), F.lit(1.0).alias("size"), "event_id")


@query("stream_closed_bars", f"""WITH {B}, m AS (SELECT max(epoch_ms(ts)) - 600000 AS wm FROM events) SELECT symbol, ts, o AS open, h AS high, l AS low, c AS close, v AS volume, v::BIGINT AS n_bars, ts + 3600000 AS known_ts FROM b, m WHERE ts + 3600000 <= wm""")
def stream_closed_bars(spark, d):
    bars = ST.closed_bars(_event_stream(spark, d), "1 hour", "10 minutes")
    return _run_stream(spark, bars, bars)


@query("stream_first_pages", "SELECT event_type AS symbol, event_id, value AS price FROM events")
def stream_first_pages(spark, d):
    s = _event_stream(spark, d)
    twice = s.withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_c")
    out = ST.first_pages(twice, ["symbol", "event_id"], "1 hour").select("symbol", "event_id", "price")
    return _run_stream(spark, out, out)


STREAM_FILES = 6


def _bar_stream(spark, d):
    """Numbered bars as a file stream: a file per span of time, one file to a micro-batch, oldest first."""
    bars = T.bars(spark, d)
    path = f"{shared_dir(spark)}/ohlcraft/feed-{uuid.uuid4().hex}"
    last = bars.agg(F.max("idx")).first()[0] or 0
    for k in range(STREAM_FILES):  # written one after the other, as a feed would; the source orders files by their time
        span = (c("idx") * STREAM_FILES / (last + 1)).cast("int") == k
        bars.filter(span).coalesce(1).sortWithinPartitions("symbol", "idx").write.mode("append").parquet(path)
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_ema", Sql().ema("y", "c", 14).out("y"))
def stream_ema(spark, d):
    out = ST.stateful(_bar_stream(spark, d), ST.ema_kernel(14), ["close"], {"y": "double"})
    return _run_stream(spark, out, out).select("symbol", "idx", F.when(c("idx") >= 13, r6("y")).alias("y"))


@query("stream_zigzag", f"WITH RECURSIVE {_ZIGZAG} SELECT symbol, confirm_idx AS idx, idx AS pivot_idx, price AS pivot_price, kind::BIGINT AS pivot_kind FROM pv")
def stream_zigzag(spark, d):
    out = ST.stateful(_bar_stream(spark, d), K.zigzag(80.0), ["idx", "high", "low"], {"pivot_idx": "long", "pivot_price": "double", "pivot_kind": "long"})
    return _run_stream(spark, out, out).filter("pivot_kind != 0")


@query("stream_resolved_trades", f"WITH {B} SELECT s.symbol, s.idx AS sig_idx, count(*) AS bars, {sr('max(b.h - s.c)')} AS best, {sr('max(s.c - b.l)')} AS worst FROM b s JOIN b ON b.symbol = s.symbol AND b.ts > s.ts AND b.ts <= s.ts + 21600000 WHERE s.c > s.o * 2 GROUP BY 1, 2")
def stream_resolved_trades(spark, d):
    """Signals joined to the bars of their next six hours as both arrive."""
    s = _bar_stream(spark, d).withColumn("at", F.timestamp_millis("ts"))
    sigs = s.filter("close > open * 2").select("symbol", "at", c("idx").alias("sig_idx"), c("close").alias("entry"))
    j = ST.resolve(sigs, s.select("symbol", "at", "idx", "high", "low"), 6 * HOUR_MS, "1 hour").select("s.symbol", "sig_idx", "entry", "idx", "high", "low")
    out = _run_stream(spark, j, j)
    return out.groupBy("symbol", "sig_idx").agg(F.count(F.lit(1)).alias("bars"), r6(F.max(c("high") - c("entry"))).alias("best"), r6(F.max(c("entry") - c("low"))).alias("worst"))


# -- archive -----------------------------------------------------------------
@query("text_chunks", """WITH RECURSIVE d AS (SELECT doc_id, source, trim(replace(text, chr(10), chr(10) || chr(10)), ' ' || chr(10)) AS body FROM documents), p AS MATERIALIZED (SELECT doc_id, source, string_split(body, chr(10) || chr(10)) AS ps, length(body) AS len FROM d WHERE body <> ''),
k AS (SELECT doc_id, source, ps, len, 1 AS i, 0 AS piece, ps[1] AS buf, length(ps[1]) + 2 AS n, false AS done FROM p
 UNION ALL SELECT doc_id, source, ps, len, i + 1, CASE WHEN len > 600 AND n + length(ps[i + 1]) + 2 > 600 THEN piece + 1 ELSE piece END,
  CASE WHEN len > 600 AND n + length(ps[i + 1]) + 2 > 600 THEN ps[i + 1] ELSE buf || chr(10) || chr(10) || ps[i + 1] END, CASE WHEN len > 600 AND n + length(ps[i + 1]) + 2 > 600 THEN length(ps[i + 1]) + 2 ELSE n + length(ps[i + 1]) + 2 END, false FROM k WHERE i < len(ps)),
m AS (SELECT doc_id, source, piece, arg_max(buf, i) AS text FROM k GROUP BY 1, 2, 3) SELECT doc_id, piece AS n, length(text)::INTEGER AS chars, substr(sha256(source || ':' || source || ':' || piece || ':' || substr(text, 1, 50)), 1, 16) AS chunk_id FROM m""")
def text_chunks(spark, d):
    docs = T.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return AR.text_chunks(docs).select("doc_id", "n", F.length("text").alias("chars"), "chunk_id")


@query("cosine_top_k", f"""WITH q AS (SELECT vec_id AS q_id, embedding AS e FROM embeddings WHERE vec_id < 8), s AS (SELECT q_id, vec_id, list_dot_product(p.embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))) AS score FROM embeddings p, q WHERE label = 1)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, {sr('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s.score DESC, vec_id) <= 5""")
def cosine_top_k(spark, d):
    e = T.table(spark, d, "embeddings")
    q = e.filter("vec_id < 8").select(c("vec_id").alias("q_id"), "embedding")
    return AR.cosine_top_k(e.filter("label = 1"), q, 5).select("q_id", "rank", "vec_id", r6("score").alias("score"))


@query("cosine_top_k_all", f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), s AS (SELECT q.vec_id AS q_id, p.vec_id, CASE WHEN p.n * q.n > 0 THEN list_dot_product(p.e, q.e) / (p.n * q.n) ELSE 0 END AS score FROM v p, v q WHERE q.vec_id % 50 = 0)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, {sr('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s.score DESC, vec_id) <= 5""")
def cosine_top_k_all(spark, d):
    """Every fiftieth vector against all vectors; ``cosine_top_k`` is the search with a filter on the points."""
    e = T.table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("q_id"), "embedding")
    return AR.cosine_top_k(e, q, 5).select("q_id", "rank", "vec_id", r6("score").alias("score"))


@query("upsert_latest", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY 1")
def upsert_latest(spark, d):
    e = T.table(spark, d, "events")
    new = AR.latest_by_id(e.select("user_id", "value", F.struct("ts", "event_id").alias("version")), "user_id", "version").select("user_id", "value")
    return new.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")


@query("performance_report", "WITH " + BOOK + f"SELECT symbol, count(*) AS n_trades, {sr('sum(CASE WHEN net > 0 THEN net ELSE 0 END) / sum(CASE WHEN net < 0 THEN -net ELSE 0 END)')} AS profit_factor, {sr('avg((net > 0)::INT)')} AS win_rate, {sr('avg(e1 - e0)')} AS avg_hold_bars, {sr('sum(net)')} AS total_pnl FROM bk GROUP BY 1")
def performance_report(spark, d):
    t = book(spark, d).withColumns({"pnl": c("net"), "bars_held": c("e1") - c("e0")})
    return rounded(AR.performance(t, ["symbol"]), ["symbol", "n_trades"], ["profit_factor", "win_rate", "avg_hold_bars", "total_pnl"])


@query("baseline_gate", f"WITH {B}, g AS (SELECT symbol, avg(c) AS s, avg(v) AS p FROM b GROUP BY 1), m AS (SELECT 41.0::DOUBLE AS bs, 2.9::DOUBLE AS bp) SELECT symbol, CASE WHEN (s - bs) / bs * 100 > 5 OR (p - bp) / bp * 100 > 5 THEN 'pass' WHEN s >= bs AND p >= bp THEN 'simplify' ELSE 'fail' END AS gate FROM g, m")
def baseline_gate(spark, d):
    g = T.bars(spark, d).groupBy("symbol").agg(F.avg("close").alias("s"), F.avg("volume").alias("p"))
    return g.select("symbol", AR.baseline_gate(c("s"), c("p"), F.lit(41.0), F.lit(2.9)).alias("gate"))


@query("risk_rules", "WITH " + TR + f"""SELECT symbol, idx, CASE WHEN reason = 'time' THEN 'no_stop_or_target' WHEN abs(risk) / close < 0.5 THEN 'stop_too_near' WHEN 3 * risk / close < 2 THEN 'target_too_near' END AS refused, {sr('least(10000 * 0.1 / close, 50, 40)')} AS size FROM tr""")
def risk_rules(spark, d):
    t = trades(spark, d).withColumns({"entry_price": c("close"), "sl": F.when(c("reason") != "time", c("close") - O.sign() * c("risk")), "tp": c("close") + O.sign() * 3 * c("risk")})
    return t.select("symbol", "idx", AR.stop_required(0.5, 2.0).alias("refused"), r6(AR.position_size(F.lit(10000.0), F.lit(0.1), F.lit(50.0), c("close"), F.lit(40.0))).alias("size"))


@query("class_accuracy", f"WITH {B}, y AS (SELECT sign(c - o)::INTEGER AS actual, sign(h + l - 2 * o)::INTEGER AS guess FROM b) SELECT actual, count(*) AS n, {sr('avg((actual = guess)::INT)')} AS accuracy FROM y GROUP BY 1")
def class_accuracy(spark, d):
    y = T.bars(spark, d).select(F.signum(c("close") - c("open")).cast("int").alias("actual"), F.signum(c("high") + c("low") - 2 * c("open")).cast("int").alias("guess"))
    return rounded(AR.class_accuracy(y, "actual", "guess"), ["actual", "n"], ["accuracy"])
