"""Catalog, peaks, zone lookups, clusters, sinks and the remaining compositions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import catalog as CA
from ..functions import volatility as V
from ..operators.asof import asof
from ..operators.frames import DAY_MS, HOUR_MS, Frame, number_bars
from ..operators.resample import resample
from ..plans import factors as FA
from ..plans import outcomes as O
from ..plans import panel as PN
from ..plans import portfolio as P
from ..plans import rulebook as RB
from ..plans import signals as G
from ..plans import structure as S
from ..sources import payloads as PL
from ..sources import tables as T
from ..sources.store import shared_dir, stored
from .base import ORACLES, ORD, Sql, avg, bars_sql, brands_sql, full, lag, query, r6, rounded, sr, win
from .research import _FE, _RET, returns
from .structure import _ROWS, _SW, blocks, rows
from .trading import BOOK, EV, SIG, STREAM, TR, book, sig, stream, trades
from .volatility import tr_sql

c = F.col
B = f"b AS MATERIALIZED ({bars_sql()})"


@query("bulk_indicators", Sql().add(sma_value=avg("c", 10), roc_roc=f"100 * (c - {lag('c', 10)}) / {lag('c', 10)}", stdev_close_stdev=full("stddev_samp(c)", "c", 30), doji_doji="0.0").ema("ema_value", "c", 10).text(
    "SELECT 'sma_value' AS \"column\", count(sma_value) AS n, " + sr("avg(sma_value)", 5) + " AS mean FROM $ UNION ALL SELECT 'roc_roc', count(roc_roc), " + sr("avg(roc_roc)", 5)
    + " FROM $ UNION ALL SELECT 'stdev_close_stdev', count(stdev_close_stdev), " + sr("avg(stdev_close_stdev)", 5) + " FROM $ UNION ALL SELECT 'ema_value', count(ema_value), " + sr("avg(ema_value)", 5) + " FROM $"))
def bulk_indicators(spark, d):
    long = CA.bulk(T.bars(spark, d), ["sma", "roc", "stdev", "ema"])
    return rounded(long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), ["column", "n"], ["mean"], 5)


@query("bulk_all_indicators")
def bulk_all_indicators(spark, d):
    """Every rolling indicator and pattern of the catalog with its defaults."""
    names = [n for n, s in sorted(CA.CATALOG.items()) if not s.recursive and not n.startswith("cdl_")]
    long = CA.bulk(T.bars(spark, d), names)
    return long.groupBy("column").agg(F.count("value").alias("n"), r6(F.avg("value"), 4).alias("mean"))


@query("features_at_events", "WITH " + EV + f" SELECT s.symbol, s.idx, {sr('s.c - s.o')} AS body, {sr('(s.h - s.l) / s.c')} AS rng FROM s JOIN ev USING (symbol, idx)")
def features_at_events(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule())
    out = CA.rules_at(T.bars(spark, d), ev, {"body": c("close") - c("open"), "rng": (c("high") - c("low")) / c("close")})
    return rounded(out, ["symbol", "idx"], ["body", "rng"])


# -- peaks: checked against a quadratic restatement of the definition ---------
def peaks_sql(x: str, price: str, prominence: float, distance: int) -> str:
    return f"""WITH RECURSIVE {B}, x AS MATERIALIZED (SELECT symbol, idx, {x} AS x, {lag(x)} AS p, lead({x}) OVER {ORD} AS n FROM b), k AS MATERIALIZED (SELECT symbol, idx, x FROM x WHERE x > p AND x > n),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x DESC, idx) AS r FROM k),
w AS (SELECT symbol, 0::BIGINT AS r, []::BIGINT[] AS kept FROM o WHERE r = 1 UNION ALL SELECT w.symbol, w.r + 1, CASE WHEN len(list_filter(w.kept, lambda q: abs(q - o.idx) < {distance})) = 0 THEN list_append(w.kept, o.idx) ELSE w.kept END FROM w JOIN o ON o.symbol = w.symbol AND o.r = w.r + 1),
f AS (SELECT symbol, unnest(arg_max(kept, r)) AS idx FROM w GROUP BY symbol), g AS (SELECT f.symbol, f.idx, x.x FROM f JOIN x USING (symbol, idx)),
sd AS (SELECT g.*, (SELECT max(z.idx) FROM x z WHERE z.symbol = g.symbol AND z.idx < g.idx AND z.x <= g.x - {prominence}) AS ld, (SELECT max(z.idx) FROM x z WHERE z.symbol = g.symbol AND z.idx < g.idx AND z.x > g.x) AS lu,
 (SELECT min(z.idx) FROM x z WHERE z.symbol = g.symbol AND z.idx > g.idx AND z.x <= g.x - {prominence}) AS rd, (SELECT min(z.idx) FROM x z WHERE z.symbol = g.symbol AND z.idx > g.idx AND z.x > g.x) AS ru FROM g)
SELECT symbol, idx, {price} AS price FROM sd WHERE ld IS NOT NULL AND (lu IS NULL OR ld > lu) AND rd IS NOT NULL AND (ru IS NULL OR rd < ru)"""


@query("peak_finder", peaks_sql("h", "x", 5, 5))
def peak_finder(spark, d):
    return S.peaks(T.bars(spark, d), "high", 5.0, 5)


@query("valley_finder", peaks_sql("-l", "-x", 1, 8))
def valley_finder(spark, d):
    return S.peaks(T.bars(spark, d), "low", 1.0, 8, valley=True)


# -- zone lookups -------------------------------------------------------------
_FZ = _SW + """, fz AS (SELECT rw.symbol, rw.idx, min(block_id) AS block_id FROM rw JOIN ob ON ob.symbol = rw.symbol AND ob.end_idx <= rw.idx AND (rw.h BETWEEN zone_low AND zone_high OR rw.l BETWEEN zone_low AND zone_high) GROUP BY 1, 2)"""


@query("first_zone_at_bar", f"WITH {_FZ} SELECT symbol, idx, block_id::BIGINT AS block_id FROM fz")
def first_zone_at_bar(spark, d):
    return S.first_zone_at(rows(spark, d).select("symbol", "idx", "high", "low"), blocks(spark, d), ["high", "low"])


@query("zone_strategy_labels", f"""WITH RECURSIVE {_FZ}, dc AS (SELECT fz.symbol, fz.idx, ob.block_type = 'demand' AS is_long, CASE WHEN ob.block_type = 'demand' THEN 1 ELSE -1 END AS sg, rw.c + CASE WHEN ob.block_type = 'demand' THEN 2 ELSE -2 END * rw.atr AS tp, rw.c - CASE WHEN ob.block_type = 'demand' THEN 1.5 ELSE -1.5 END * rw.atr AS sl
 FROM fz JOIN ob ON ob.symbol = fz.symbol AND ob.block_id = fz.block_id JOIN rw ON rw.symbol = fz.symbol AND rw.idx = fz.idx WHERE rw.atr > 0), ef AS MATERIALIZED (SELECT dc.*, z.o * (1 + sg * 0.0005) AS fill, li FROM dc JOIN rw z ON z.symbol = dc.symbol AND z.idx = dc.idx + 1),
wk AS (SELECT e.symbol, e.idx, min(CASE WHEN (is_long AND z.l <= sl) OR (NOT is_long AND z.h >= sl) THEN z.idx * 2 WHEN (is_long AND z.h >= tp) OR (NOT is_long AND z.l <= tp) THEN z.idx * 2 + 1 END) AS code, max(z.idx) AS lj, arg_max(z.c, z.idx) AS lc FROM ef e JOIN rw z ON z.symbol = e.symbol AND z.idx BETWEEN e.idx + 1 AND e.idx + 12 GROUP BY 1, 2),
oc AS MATERIALIZED (SELECT e.*, CASE WHEN code IS NOT NULL THEN code // 2 WHEN lj = e.idx + 12 THEN lj ELSE -1 END AS xi, CASE WHEN code % 2 = 1 THEN tp WHEN code % 2 = 0 THEN sl * (1 - sg * 0.0005) WHEN lj = e.idx + 12 THEN lc * (1 - sg * 0.0005) END AS px, row_number() OVER (PARTITION BY e.symbol ORDER BY e.idx) - 1 AS k FROM ef e JOIN wk USING (symbol, idx)),
sm AS (SELECT symbol, k, xi AS busy, true AS took FROM oc WHERE k = 0 UNION ALL SELECT n.symbol, n.k, CASE WHEN p.busy >= 0 AND n.idx > p.busy THEN n.xi ELSE p.busy END, p.busy >= 0 AND n.idx > p.busy FROM sm p JOIN oc n ON n.symbol = p.symbol AND n.k = p.k + 1),
tk AS (SELECT oc.* FROM oc JOIN sm USING (symbol, k) WHERE took)
SELECT rw.symbol, rw.idx, CASE WHEN x.idx IS NOT NULL THEN 2 WHEN e.idx IS NOT NULL THEN 1 ELSE -100 END AS action, {sr('CASE WHEN e.xi >= 0 THEN (e.sg * (e.px - e.fill) - 0.001 * (e.fill + e.px)) / abs(e.fill - e.sl) END', 5)} AS outcome
FROM rw LEFT JOIN tk e ON e.symbol = rw.symbol AND e.idx = rw.idx LEFT JOIN (SELECT symbol, xi AS idx FROM tk WHERE xi >= 0) x ON x.symbol = rw.symbol AND x.idx = rw.idx""")
def zone_strategy_labels(spark, d):
    """Trades opened where a bar touches the first broken zone that holds its high or low."""
    at = S.first_zone_at(rows(spark, d).select("symbol", "idx", "high", "low"), blocks(spark, d), ["high", "low"])
    e = at.join(blocks(spark, d).select("symbol", "block_id", "block_type"), ["symbol", "block_id"]).join(rows(spark, d).select("symbol", "idx", "close", "atr"), ["symbol", "idx"])
    e = e.withColumn("is_long", c("block_type") == "demand").withColumns({"tp": c("close") + O.sign() * 2 * c("atr"), "sl": c("close") - O.sign() * 1.5 * c("atr")})
    labels = PN.strategy_labels(e.filter((c("atr") > 0) & PN.reward_ok()), rows(spark, d), 12)
    return labels.select("symbol", "idx", "action", r6("outcome", 5).alias("outcome"))


@query("nearest_zones", f"""WITH {_SW}, p AS (SELECT rw.symbol, rw.idx, min(CASE WHEN zone_high <= rw.c THEN rw.c - zone_high WHEN zone_low < rw.c THEN 0 END) AS below, min(CASE WHEN zone_high <= rw.c THEN NULL WHEN zone_low >= rw.c THEN zone_low - rw.c ELSE 0 END) AS above
 FROM rw JOIN ob ON ob.symbol = rw.symbol AND ob.confirm_idx <= rw.idx GROUP BY 1, 2) SELECT rw.symbol, rw.idx, {sr('below')} AS below, {sr('above')} AS above FROM rw LEFT JOIN p USING (symbol, idx)""")
def nearest_zones(spark, d):
    return rounded(S.nearest_zones(rows(spark, d), blocks(spark, d), "confirm_idx"), ["symbol", "idx"], ["below", "above"])


@query("stop_levels", "WITH " + EV + f""", r AS (SELECT unnest(['atr:1', 'atr:3']) AS rule), t AS (SELECT unnest([2.0, 3.0])::DOUBLE AS target_r) SELECT symbol, idx, rule, target_r, {sr("close - sg * CASE WHEN rule = 'atr:1' THEN 1 ELSE 3 END * atr")} AS stop, {sr("close + sg * target_r * CASE WHEN rule = 'atr:1' THEN 1 ELSE 3 END * atr")} AS target FROM ev, r, t""")
def stop_levels(spark, d):
    ev = G.entries(sig(spark, d), RB.cross_rule()).select("symbol", "idx", "close", "atr", "is_long")
    return rounded(O.stop_levels(ev, ["atr:1", "atr:3"], [2.0, 3.0], 0.5), ["symbol", "idx", "rule", "target_r"], ["stop", "target"])


# -- sources and sinks --------------------------------------------------------
def _tmp(spark):
    return f"{shared_dir(spark)}/ohlcraft/io-{uuid.uuid4().hex}"


@query("csv_bars", f"WITH {B} SELECT symbol, ts, c AS close FROM b")
def csv_bars(spark, d):
    path = _tmp(spark)
    T.bars(spark, d).select("symbol", "ts", "close").write.option("header", True).csv(path)
    return PL.read_csv_bars(spark, path, "symbol string, ts long, close double")


@query("split_sink", f"WITH {B} SELECT symbol, CASE WHEN idx < 400 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM b WHERE symbol = 'click' GROUP BY 1, 2")
def split_sink(spark, d):
    path = _tmp(spark)
    PL.write_bars(T.bars(spark, d).withColumn("split", F.when(c("idx") < 400, "train").otherwise("test")), path, ["split", "symbol"])
    return PL.read_bars(spark, path, ["click"], ["symbol", "split", "ts"]).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"))


@query("json_report", "WITH " + BOOK + f"SELECT symbol, count(*) AS n, {sr('avg(net)')} AS ev FROM bk GROUP BY 1")
def json_report(spark, d):
    path = _tmp(spark)
    rounded(P.trade_stats(book(spark, d), ["symbol"]), ["symbol", "n"], ["ev"]).write.json(path)
    return spark.read.schema("symbol string, n long, ev double").json(path)


@query("page_merge", f"WITH {B} SELECT ts, count(*) AS n FROM (SELECT DISTINCT ts FROM b) GROUP BY 1")
def page_merge(spark, d):
    b = T.bars(spark, d).select("ts")
    return b.unionByName(b).dropDuplicates(["ts"]).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))


@query("features_with_labels", f"WITH {B} SELECT symbol, idx, c AS close, CASE WHEN idx % 4 = 0 THEN 1 ELSE -100 END AS action FROM b")
def features_with_labels(spark, d):
    b = T.bars(spark, d).select("symbol", "idx", "close")
    labels = b.filter("idx % 4 = 0").select("symbol", "idx", F.lit(1).alias("action"))
    return b.join(labels, ["symbol", "idx"], "left").withColumn("action", F.coalesce("action", F.lit(-100)))


# -- portfolio ----------------------------------------------------------------
@query("correlation_clusters", _RET.replace("WITH ", "WITH RECURSIVE ", 1) + """, cm AS (SELECT a.symbol AS a, z.symbol AS z, corr(a.r, z.r) AS rho FROM r a JOIN r z USING (ts) GROUP BY 1, 2), e AS (SELECT a, z FROM cm WHERE rho > 0.05 OR a = z), rc AS (SELECT a, z FROM e UNION SELECT rc.a, e.z FROM rc JOIN e ON rc.z = e.a),
lb AS (SELECT a AS asset, min(z) AS cluster FROM rc GROUP BY 1), n AS (SELECT cluster, count(*) AS members FROM lb GROUP BY 1) SELECT asset, cluster, members, least(members, 2) AS cap FROM lb JOIN n USING (cluster)""")
def correlation_clusters(spark, d):
    return P.correlation_clusters(returns(spark, d), 0.05, by="ts")


@query("episode_overlaps")
def episode_overlaps(spark, d):
    """Deepest drawdowns of the stream that share bars with those of the stream a day later."""
    a = P.drawdown_episodes(stream(spark, d), 5)
    z = P.drawdown_episodes(stream(spark, d).filter("idx >= 24").withColumn("idx", c("idx") - 24), 5)
    return P.overlaps(a, z).select("peak_idx", "start_idx", "end_idx", r6("depth").alias("depth"))


# the row sums of the matrix are the stream, so the twin is that of the stream
@query("cross_section_bootstrap", ORACLES["block_bootstrap"])
def cross_section_bootstrap(spark, d):
    """Interval of the mean over bars of the row sums of the asset matrix."""
    x = P.accrual_direct(book(spark, d), ["symbol"]).groupBy("idx").agg(F.sum("r").alias("r"))
    full_grid = stream(spark, d).select("book", "idx").join(x, "idx", "left").fillna(0.0, ["r"])
    return P.block_bootstrap(full_grid, 60, 100).select(r6("ci_lo", 8).alias("ci_lo"), r6("ci_hi", 8).alias("ci_hi"))


@query("leg_streams", "WITH " + BOOK + f""", st AS (SELECT is_long, i.idx, sum(net / (greatest(e1 - e0, 1) + 1)) AS r FROM (SELECT unnest(range(0, (SELECT max(n) FROM bk))) AS idx) i JOIN bk ON i.idx BETWEEN e0 AND e1 GROUP BY 1, 2) SELECT CASE WHEN is_long THEN 'long' ELSE 'short' END AS book, idx, {sr('r')} AS r FROM st WHERE abs(r) > 1e-9""")
def leg_streams(spark, d):
    t = book(spark, d).withColumn("book", F.when(c("is_long"), "long").otherwise("short"))
    s = P.accrual_direct(t, ["book"])
    return rounded(s.filter(F.abs("r") > 1e-9), ["book", "idx"], ["r"])


@query("rolling_sharpe_brake", "WITH " + STREAM + f", dd AS (SELECT idx // 24 AS day, sum(r) AS r FROM st GROUP BY 1) SELECT day, {sr('CASE WHEN count(r) OVER w = 10 THEN avg(r) OVER w / nullif(stddev_pop(r) OVER w, 0) END')} AS sharpe, coalesce(CASE WHEN count(r) OVER w = 10 THEN avg(r) OVER w / nullif(stddev_pop(r) OVER w, 0) END < 0, false) AS brake FROM dd WINDOW w AS (ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def rolling_sharpe_brake(spark, d):
    day = P.rollup(stream(spark, d), 24).select("book", c("day").alias("idx"), "r")
    f = Frame.of_numbered(day, 10, key="book")
    f = f.add(_m=f.full(F.avg("r"), c("r"), 10), _s=f.full(F.stddev_pop("r"), c("r"), 10))
    f = f.add(sharpe=c("_m") / F.nullif("_s", F.lit(0.0)))
    return f.core(c("idx").alias("day"), r6("sharpe").alias("sharpe"), G.true(c("sharpe") < 0).alias("brake"))


# -- trend filters ------------------------------------------------------------
@query("adx_size", tr_sql(Sql().add(u=f"h - {lag('h')}", d=f"{lag('l')} - l")).add(pos="CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", neg="CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END").rma("a", "tr", 14, 1).rma("ps", "pos", 14).rma("ns", "neg", 14).add(
    dx="100 * abs(ps - ns) / nullif(ps + ns, 0)").add(dx2="CASE WHEN idx >= 14 THEN dx END").rma("adx", "dx2", 14, 14).add(size="CASE WHEN adx IS NOT NULL THEN greatest(0.5, least(2, adx / 25)) END").out("size"))
def adx_size(spark, d):
    f = V.adx(Frame.of_numbered(T.bars(spark, d), 30))
    return f.core("symbol", "idx", r6(F.when(c("adx").isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(2.0), c("adx") / 25)))).alias("size"))


@query("two_timeframe_agreement", f"""WITH {B}, g AS (SELECT symbol, ts // 86400000 AS dy, arg_max(c, ts) AS c, count(*) AS n FROM b GROUP BY 1, 2), e AS (SELECT symbol, max(ts) + 3600000 AS fin FROM b GROUP BY 1), g2 AS (SELECT g.symbol, (dy + 1) * 86400000 AS known_ts, c, avg(c) OVER (PARTITION BY g.symbol ORDER BY dy ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY g.symbol ORDER BY dy ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k FROM g JOIN e USING (symbol) WHERE (dy + 1) * 86400000 <= fin),
x AS (SELECT *, {full('avg(c)', 'c', 20)} AS m FROM b) SELECT x.symbol, x.idx, coalesce(x.c > x.m AND g2.c > g2.m AND g2.k = 5, false) AS agree FROM x ASOF LEFT JOIN g2 ON g2.symbol = x.symbol AND x.ts >= g2.known_ts""")
def two_timeframe_agreement(spark, d):
    b = T.bars(spark, d)
    day = number_bars(resample(b, DAY_MS, HOUR_MS), DAY_MS)
    f = Frame.of_numbered(day, 6)
    day = f.add(up=c("close") > f.full(F.avg("close"), c("close"), 5)).core("symbol", "known_ts", "up")
    g = Frame.of_numbered(b, 21)
    base = g.add(m=g.full(F.avg("close"), c("close"), 20)).core("symbol", "idx", "ts", "close", "m")
    j = asof(base, day, "ts", "known_ts", ["up"], 7 * DAY_MS, prefix="d_")
    return j.select("symbol", "idx", G.true((c("close") > c("m")) & c("d_up")).alias("agree"))


@query("regime_trigger_coverage", _FE.text("SELECT symbol, count_if(z < -1)::BIGINT AS triggered, min(CASE WHEN z < -1 THEN idx END) AS first_idx, count(z) AS n FROM $ GROUP BY 1"))
def regime_trigger_coverage(spark, d):
    from .research import features

    g = features(spark, d).groupBy("symbol").agg(F.count_if(c("z") < -1).alias("triggered"), F.min(F.when(c("z") < -1, c("idx"))).alias("first_idx"), F.count("z").alias("n"))
    return g


@query("candidate_group_ids", f"WITH {B} SELECT symbol, idx, dense_rank() OVER (ORDER BY symbol, idx // 8) - 1 AS grp FROM b")
def candidate_group_ids(spark, d):
    """Dense group numbers over all symbols: groups are ranked once, rows join their group."""
    from ..operators.frames import ordinals

    b = T.bars(spark, d).select("symbol", "idx", F.floor(c("idx") / 8).alias("g"))
    ids = ordinals(b.select("symbol", "g").distinct(), [], ["symbol", "g"], "grp")
    return b.join(ids, ["symbol", "g"]).select("symbol", "idx", "grp")


@query("gap_and_volume_report", f"WITH {B}, x AS (SELECT symbol, v, ts - {lag('ts')} AS gap FROM b) SELECT symbol, {sr('avg((gap > 3600000)::INT)')} AS gap_share, {sr('stddev_pop(v) / avg(v)')} AS vol_cv FROM x GROUP BY 1")
def gap_and_volume_report(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 1)
    x = f.add(gap=c("ts") - f.lag(c("ts"))).core()
    return rounded(x.groupBy("symbol").agg(F.avg((c("gap") > HOUR_MS).cast("double")).alias("gap_share"), (F.stddev_pop("volume") / F.avg("volume")).alias("vol_cv")), ["symbol"], ["gap_share", "vol_cv"])
