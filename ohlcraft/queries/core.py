"""Sources, joins, reshaping, conditions and rolling primitives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import asof as A
from ..operators import resample as RS
from ..operators.frames import DAY_MS, HOUR_MS, WEEK_MS, Frame
from ..operators.running import running
from ..operators.scan import asof_sorted
from ..plans import crosssection as X
from ..plans import signals as G
from ..sources import payloads as P
from ..sources import tables as T
from ..sources.store import settled, stored
from .base import ORD, Sql, avg, bars_sql, brands_sql, div, full, indicator, lag, mn, mx, query, r6, rounded, sm, sr, win, USERS_SQL

c = F.col
B = f"b AS MATERIALIZED ({bars_sql()})"
BR = f"b AS MATERIALIZED ({brands_sql()})"
OHLC = ["open", "high", "low", "close", "volume"]
S_OHLC = "o AS open, h AS high, l AS low, c AS close, v AS volume"


def _resample_sql(ms: int, base: int = HOUR_MS, shift: int = 0) -> str:
    return f"""WITH {B}, g AS (SELECT symbol, ((ts - {shift}) // {ms}) * {ms} + {shift} AS ts, arg_min(o, ts) AS open, max(h) AS high, min(l) AS low,
 arg_max(c, ts) AS close, sum(v) AS volume, count(*) AS n_bars FROM b GROUP BY 1, 2), e AS (SELECT symbol, max(ts) + {base} AS fin FROM b GROUP BY 1)
SELECT g.*, g.ts + {ms} AS known_ts FROM g JOIN e USING (symbol) WHERE g.ts + {ms} <= fin"""


@query("bars_1h", f"WITH {B} SELECT symbol, ts, idx, {S_OHLC} FROM b")
def bars_1h(spark, d):
    return T.bars(spark, d)


@query("bars_users", f"WITH b AS ({USERS_SQL}) SELECT symbol, ts, idx, {S_OHLC} FROM b")
def bars_users(spark, d):
    return T.users(spark, d)


@query("bars_brands", f"WITH {BR} SELECT symbol, ts, idx, {', '.join(f'{sr(s)} AS {n}' for s, n in zip('ohlcv', OHLC))} FROM b")
def bars_brands(spark, d):
    return rounded(T.brands(spark, d), ["symbol", "ts", "idx"], OHLC)


for _bar, _shift in (("4h", 0), ("1d", 0), ("1w", 345_600_000)):
    _ms = RS.duration_ms(_bar)
    query(f"resample_{_bar}", _resample_sql(_ms, shift=_shift))(lambda spark, d, m=_ms: RS.resample(T.bars(spark, d), m, HOUR_MS))


@query("bucket_bars", f"""WITH {B} SELECT symbol, ts // 14400000 AS bucket, min(ts) AS ts, max(h) AS high, min(l) AS low, arg_max(c, ts) AS close, sum(v) AS volume
FROM b GROUP BY 1, 2""")
def bucket_bars(spark, d):
    return RS.bucket_bars(T.bars(spark, d), 4 * HOUR_MS)


@query("daily_close", f"WITH {B} SELECT symbol, ts // 86400000 AS bucket, arg_max(c, ts) AS close FROM b GROUP BY 1, 2")
def daily_close(spark, d):
    return RS.closes(T.bars(spark, d), DAY_MS)


@query("asof_higher_timeframe", f"""WITH h AS ({_resample_sql(DAY_MS)}), {B}
SELECT b.symbol, b.idx, h.close AS d_close, h.n_bars AS d_n_bars, b.ts - h.known_ts AS age FROM b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.known_ts""")
def asof_higher_timeframe(spark, d):
    b = T.bars(spark, d)
    day = RS.resample(b, DAY_MS, HOUR_MS)
    return A.asof(b, day, "ts", "known_ts", ["close", "n_bars"], 7 * DAY_MS, prefix="d_", age="age").select("symbol", "idx", "d_close", "d_n_bars", "age")


@query("asof_forward_index", f"""WITH h AS ({_resample_sql(DAY_MS)}), {B}
SELECT h.symbol, h.ts, b.idx AS base_idx FROM h ASOF LEFT JOIN b ON h.symbol = b.symbol AND h.known_ts <= b.ts""")
def asof_forward_index(spark, d):
    b = T.bars(spark, d)
    day = RS.resample(b, DAY_MS, HOUR_MS).select("symbol", "ts", "known_ts")
    return A.asof(day, b, "known_ts", "ts", ["idx"], 7 * DAY_MS, prefix="base_", forward=True).select("symbol", "ts", "base_idx")


@query("asof_last_completed_day", f"""WITH {B}, g AS (SELECT symbol, ts // 86400000 AS day, arg_max(c, ts) AS close FROM b GROUP BY 1, 2)
SELECT b.symbol, b.idx, g.close AS prev_day_close FROM b LEFT JOIN g ON g.symbol = b.symbol AND g.day = b.ts // 86400000 - 1""")
def asof_last_completed_day(spark, d):
    b = T.bars(spark, d)
    day = RS.closes(b, DAY_MS).select("symbol", (c("bucket") + 1).alias("_d"), c("close").alias("prev_day_close"))
    return b.withColumn("_d", F.floor(c("ts") / DAY_MS)).join(day, ["symbol", "_d"], "left").select("symbol", "idx", "prev_day_close")


@query("asof_spot_lookup", """WITH o AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS t FROM orders), s AS (SELECT epoch_ms(l_shipdate) AS t, min(l_extendedprice / l_quantity) AS px FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, s.px FROM o ASOF LEFT JOIN s ON o.t >= s.t""")
def asof_spot_lookup(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", T.epoch_ms(c("o_orderdate")).alias("t"))
    li = T.table(spark, d, "lineitem")
    s = li.groupBy(T.epoch_ms(c("l_shipdate")).alias("st")).agg(F.min(c("l_extendedprice") / c("l_quantity")).alias("px"))
    return asof_sorted(o, s, "t", "st", ["px"]).select("o_orderkey", "px")


@query("upsert_keep_first", f"WITH {B} SELECT symbol, ts, CASE WHEN idx < 500 THEN c ELSE c + 1 END AS close FROM b")
def upsert_keep_first(spark, d):
    b = T.bars(spark, d).select("symbol", "ts", "idx", "close")
    old = b.filter("idx < 500").drop("idx")
    new = b.filter("idx >= 300").select("symbol", "ts", (c("close") + 1).alias("close"))
    return A.keep_first([old, new], ["symbol", "ts"])


@query("incremental_load", f"WITH {B} SELECT symbol, ts, c AS close FROM b WHERE NOT (idx BETWEEN 100 AND 400)")
def incremental_load(spark, d):
    b = T.bars(spark, d).select("symbol", "ts", "idx", "close")
    return P.increment(b, b.filter("idx between 100 and 400")).select("symbol", "ts", "close")


@query("high_water", f"WITH {B} SELECT symbol, min(ts) AS oldest, max(ts) AS newest, count(*) AS n FROM b GROUP BY 1")
def high_water(spark, d):
    return P.high_water(T.bars(spark, d))


@query("tail_bars", f"WITH {B} SELECT symbol, ts, c AS close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def tail_bars(spark, d):
    b = T.bars(spark, d)
    last = b.groupBy("symbol").agg(F.max("idx").alias("_l"))
    return b.join(last, "symbol").filter(c("idx") > c("_l") - 20).select("symbol", "ts", "close")


@query("source_priority", f"""WITH {B}, a AS (SELECT symbol, ts, c AS close, 'main' AS source FROM b WHERE idx % 3 <> 0), z AS (SELECT symbol, ts, c - 1 AS close, 'backup' AS source FROM b)
SELECT * FROM a UNION ALL SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = z.symbol AND a.ts = z.ts)""")
def source_priority(spark, d):
    b = T.bars(spark, d)
    main = b.filter("idx % 3 != 0").select("symbol", "ts", "close", F.lit("main").alias("source"))
    return A.keep_first([main, b.select("symbol", "ts", (c("close") - 1).alias("close"), F.lit("backup").alias("source"))], ["symbol", "ts"])


@query("history_filter", f"WITH b AS ({USERS_SQL}) SELECT symbol, ts, c AS close FROM b QUALIFY count(*) OVER (PARTITION BY symbol) >= 25")
def history_filter(spark, d):
    b = T.users(spark, d)
    keep = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 25")
    return b.join(keep, "symbol", "left_semi").select("symbol", "ts", "close")


@query("epoch_unit", f"WITH {B} SELECT symbol, ts, c AS close FROM b")
def epoch_unit(spark, d):
    b = T.bars(spark, d).select("symbol", "ts", "close")
    mixed = b.withColumn("ts", F.when(c("symbol") < "p", (c("ts") / 1000).cast("long")).otherwise(c("ts")))
    return P.epoch_to_ms(mixed, by=["symbol"])


def _payload(b):
    s = [c(x).cast("string") for x in ("ts", *OHLC)]
    return b.select("symbol", "idx", F.array(*s, (c("ts") + HOUR_MS - 1).cast("string"), (c("close") * c("volume")).cast("string"),
                                             F.when(c("idx") % 5 != 0, "1").otherwise("0"), F.lit("2.5")).alias("row"))


@query("kline_payload", f"""WITH {B}, m AS (SELECT max(ts) AS t FROM b) SELECT symbol, ts, {S_OHLC}, ts + 3599999 AS close_time, {sr('c * v')} AS quote_volume,
 CASE WHEN idx % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_trades, 2.5::DOUBLE AS taker_buy_volume FROM b, m WHERE ts + 3599999 <= m.t""")
def kline_payload(spark, d):
    b = T.bars(spark, d)
    now = b.agg(F.max("ts").alias("_now"))
    k = P.klines(_payload(b), F.lit(2**62))
    return k.crossJoin(F.broadcast(now)).filter("close_time <= _now").drop("_now").withColumn("quote_volume", r6("quote_volume"))


@query("candle_payload", f"WITH {B} SELECT symbol, ts, {S_OHLC} FROM b WHERE idx % 5 <> 0")
def candle_payload(spark, d):
    return P.candles(_payload(T.bars(spark, d)))


@query("funding_payload", "SELECT event_type AS symbol, event_id AS ts, value AS rate FROM events")
def funding_payload(spark, d):
    e = T.table(spark, d, "events")
    raw = e.select(c("event_type").alias("symbol"), F.to_json(F.struct(c("event_id").cast("string").alias("fundingTime"), c("value").cast("string").alias("fundingRate"))).alias("payload"))
    return P.rates(raw)


@query("open_interest_payload", "SELECT event_type AS symbol, event_id AS ts, value AS oi, value * 2 AS oi_quote FROM events")
def open_interest_payload(spark, d):
    e = T.table(spark, d, "events")
    raw = e.select(c("event_type").alias("symbol"), F.to_json(F.struct(
        c("event_id").cast("string").alias("timestamp"), c("value").cast("string").alias("sumOpenInterest"),
        (c("value") * 2).cast("string").alias("sumOpenInterestValue"))).alias("payload"))
    return P.open_interest(raw)


@query("json_props", "SELECT event_type, sum((props ->> 'k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    e = T.table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


@query("partitioned_scan", f"WITH {B} SELECT ts, c AS close, symbol FROM b WHERE symbol IN ('click', 'view')")
def partitioned_scan(spark, d):
    b = stored(spark, "bars_by_symbol", d, lambda: T.bars(spark, d), partitions=["symbol"])
    return b.filter(c("symbol").isin("click", "view")).select("ts", "close", "symbol")


@query("defaults_for_missing", f"WITH {B} SELECT symbol, ts, 0.0::DOUBLE AS strength, coalesce(CASE WHEN idx % 2 = 0 THEN 'up' END, 'none') AS trend, -1::BIGINT AS retest_idx FROM b")
def defaults_for_missing(spark, d):
    b = T.bars(spark, d).select("symbol", "ts", F.when(c("idx") % 2 == 0, "up").alias("trend"))
    return P.with_defaults(b, {"strength": ("double", 0.0), "trend": ("string", "none"), "retest_idx": ("long", -1)})


@query("split_adjust", f"WITH {B} SELECT symbol, ts, {sr('o * 0.5')} AS open, {sr('h * 0.5')} AS high, {sr('l * 0.5')} AS low, {sr('c * 0.5')} AS close FROM b")
def split_adjust(spark, d):
    b = T.bars(spark, d).withColumns({"closeadj": c("close") * 0.5, "closeunadj": c("close")})
    return rounded(P.split_adjusted(b), ["symbol", "ts"], ["open", "high", "low", "close"])


@query("dense_grid", f"""WITH {B}, g AS (SELECT symbol, unnest(range(min(ts), max(ts) + 1, 3600000)) AS ts FROM b GROUP BY symbol)
SELECT g.symbol, g.ts, coalesce(b.v, 0) AS volume FROM g LEFT JOIN b USING (symbol, ts)""")
def dense_grid(spark, d):
    b = T.bars(spark, d)
    return RS.dense_grid(b, "ts", HOUR_MS).join(b.select("symbol", "ts", "volume"), ["symbol", "ts"], "left").fillna(0.0, ["volume"])


@query("common_buckets", f"WITH {B} SELECT symbol, ts, c AS close FROM b QUALIFY count(*) OVER (PARTITION BY ts) = 5")
def common_buckets(spark, d):
    return RS.common_buckets(T.bars(spark, d), "ts").select("symbol", "ts", "close")


@query("outer_align", f"""WITH {B}, t AS (SELECT DISTINCT ts FROM b), s AS (SELECT DISTINCT symbol FROM b), g AS (SELECT * FROM t, s)
SELECT g.ts, sum(coalesce(b.c, 0)) AS total, count(b.c) AS n FROM g LEFT JOIN b USING (ts, symbol) GROUP BY g.ts""".replace("sum(coalesce(b.c, 0)) AS total", f"{sr('sum(coalesce(b.c, 0))')} AS total"))
def outer_align(spark, d):
    # absent cells count as zero, so the union of days needs no filled matrix
    b = T.bars(spark, d)
    return b.groupBy("ts").agg(r6(F.sum("close")).alias("total"), F.count("close").alias("n"))


@query("pivot_wide", f"WITH {B} SELECT ts // 86400000 AS day, " + ", ".join(f"{sr(f'''avg(CASE WHEN symbol = '{s}' THEN c END)''')} AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM b GROUP BY 1")
def pivot_wide(spark, d):
    names = ["click", "error", "purchase", "signup", "view"]
    p = T.bars(spark, d).groupBy(F.floor(c("ts") / DAY_MS).alias("day")).pivot("symbol", names).agg(F.avg("close"))
    return p.select("day", *[r6(n).alias(n) for n in names])


@query("daily_sum", "SELECT event_type AS symbol, epoch_ms(ts) // 86400000 AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_sum(spark, d):
    e = T.table(spark, d, "events")
    return e.groupBy(c("event_type").alias("symbol"), F.floor(T.epoch_ms(c("ts")) / DAY_MS).alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))


# -- conditions -------------------------------------------------------------
def _cond(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 8)
    f, up = G.rising(f, "close", 3)
    f, dn = G.falling(f, "close", 4)
    x, y = c("close"), c("volume")
    f = f.add(
        chained=G.chain(c("low"), ("<", c("open")), ("<=", c("high"))), either=G.true((x > 50) | (y > 3)), both=G.true((x > 50) & ~(y > 3)),
        up3=G.true(up), down4=G.true(dn), hist=G.history(f, "close", 3), back2=G.true(x > G.history(f, "close", 2)),
        rem=G.modulo(-x, y), quot=G.divide(x, y - 1), power=F.pow(-y, F.lit(3.0)), flag=G.number(x > c("open")))
    return rounded(f.core(), ["symbol", "idx", "chained", "either", "both", "up3", "down4", "back2"], ["hist", "rem", "quot", "power", "flag"])


query("conditions", Sql().add(p1=lag("c"), p2=lag("c", 2), p3=lag("c", 3)).text(f"""SELECT symbol, idx, l < o AND o <= h AS chained, c > 50 OR v > 3 AS "either", c > 50 AND NOT v > 3 AS "both",
 coalesce(c > p1 AND p1 > p2, false) AS up3, coalesce(c < p1 AND p1 < p2 AND p2 < p3, false) AS down4, coalesce(c > p2, false) AS back2, p3 AS hist,
 {sr('-c - floor(-c / v) * v')} AS rem, {sr('CASE WHEN v <> 1 THEN c / (v - 1) END')} AS quot, {sr('-v * v * v')} AS power, (c > o)::INT::DOUBLE AS flag FROM $"""))(_cond)


@query("let_binding", Sql().add(spread="h - l").add(y="CASE WHEN spread > 20 THEN spread * spread ELSE spread END").out("y"))
def let_binding(spark, d):
    b = T.bars(spark, d)
    spread = c("high") - c("low")
    return rounded(b.withColumn("y", F.when(spread > 20, spread * spread).otherwise(spread)), ["symbol", "idx"], ["y"])


@query("crosses", Sql().add(s=avg("c", 5), g=avg("c", 20)).add(ps=lag("s"), pg=lag("g")).text(
    "SELECT symbol, idx, coalesce(s > g AND ps < pg, false) AS cross_up, coalesce(s < g AND ps > pg, false) AS cross_down FROM $"))
def crosses(spark, d):
    f = Frame.of_numbered(T.bars(spark, d), 30)
    f = f.add(s=R.mean(f, "close", 5), g=R.mean(f, "close", 20))
    return G.crosses(f, "s", "g").core("symbol", "idx", "cross_up", "cross_down")


@query("donchian_breakouts", Sql().add(hi=full("max(h)", "h", 20, 1), lo=full("min(l)", "l", 20, 1)).text(
    "SELECT symbol, idx, coalesce(c > hi, false) AS don_up, coalesce(c < lo, false) AS don_down FROM $"))
def donchian_breakouts(spark, d):
    return G.donchian(Frame.of_numbered(T.bars(spark, d), 21)).core("symbol", "idx", "don_up", "don_down")


@query("z_entries", Sql().add(z=div(f"c - {avg('c', 20)}", full("stddev_pop(c)", "c", 20))).add(p=lag("z")).text(
    f"SELECT symbol, idx, {sr('z')} AS z, coalesce(z <= -1.5 AND p > -1.5, false) AS z_long, coalesce(z >= 1.5 AND p < 1.5, false) AS z_short FROM $"))
def z_entries(spark, d):
    f = G.z_entries(Frame.of_numbered(T.bars(spark, d), 22), 20, 1.5)
    return f.core("symbol", "idx", r6("z").alias("z"), "z_long", "z_short")


@query("taker_flow_divergence", Sql().add(s="(o / (o + h + l + c))").add(z=div(f"s - {avg('s', 30)}", full("stddev_pop(s)", "s", 30)), r=f"c - {lag('c')}").text(
    f"SELECT symbol, idx, {sr('z')} AS flow_z, CASE WHEN z > 1 AND r < 0 THEN 1 WHEN z < -1 AND r > 0 THEN -1 ELSE 0 END AS diverge FROM $"))
def taker_flow_divergence(spark, d):
    b = T.bars(spark, d).withColumns({"buy_volume": c("open"), "volume": c("open") + c("high") + c("low") + c("close")})
    return G.taker_flow(Frame.of_numbered(b, 31), 30).core("symbol", "idx", r6("flow_z").alias("flow_z"), "diverge")


@query("inf_to_null", f"WITH {B} SELECT symbol, idx, CASE WHEN v <> 1 THEN c END AS a, CASE WHEN v <> 1 THEN c ELSE 0 END AS z FROM b")
def inf_to_null(spark, d):
    b = T.bars(spark, d).withColumn("x", F.when(c("volume") == 1, F.lit(float("inf"))).otherwise(c("close")))
    ok = F.abs(c("x")) != float("inf")
    return b.select("symbol", "idx", F.when(ok, c("x")).alias("a"), F.when(ok, c("x")).otherwise(0.0).alias("z"))


def _gappy(b):
    return b.withColumn("x", F.when(c("volume") > 2, c("close")))


for _policy, _expr in (("ffill", f"last_value(x IGNORE NULLS) OVER {ORD}"),
                       ("bfill", "first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
                       ("ignore", "x")):
    query(f"nan_policy_{_policy}", Sql().add(x="CASE WHEN v > 2 THEN c END").add(y=_expr).out("y"))(
        lambda spark, d, p=_policy: G.nan_policy(Frame.of_numbered(_gappy(T.bars(spark, d)), 0), "x", p, "y").core("symbol", "idx", r6("y").alias("y")))
query("nan_policy_both", Sql().add(x="CASE WHEN v > 2 THEN c END").add(y0=f"last_value(x IGNORE NULLS) OVER {ORD}").add(
    y="first_value(y0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)").out("y"))(
    lambda spark, d: G.nan_policy(Frame.of_numbered(_gappy(T.bars(spark, d)), 0), "x", "both", "y").core("symbol", "idx", r6("y").alias("y")))
indicator("shift_fill", 3, lambda f: G.shift_fill(G.shift_fill(f, "close", 3, 0.0, "a"), "close", -2, None, "z"), ["a", "z"],
          Sql().add(a=f"coalesce({lag('c', 3)}, 0)", z=f"lead(c, 2) OVER {ORD}").out("a", "z"), ahead=2)

# -- rolling primitives -----------------------------------------------------
indicator("rolling_extremes", 20, lambda f: f.add(a=R.rolling_max(f, "high", 20), z=R.rolling_min(f, "low", 20), s=R.rolling_sum(f, "volume", 20)),
          ["a", "z", "s"], Sql().add(a=mx("h", 20), z=mn("l", 20), s=sm("v", 20)).out("a", "z", "s"))
indicator("expanding_mean", 20, lambda f: f.add(y=R.expanding_mean(f, "close", 20)), ["y"], Sql().add(y=f"avg(c) OVER {win(20)}").out("y"))
indicator("cumulative", 0, lambda f: running(f, a=("max", c("close")), z=("min", c("close")), s=("sum", c("volume")), p=("sum", F.log1p(0.001 * c("close")))),
          ["a", "z", "s", "p"], Sql().add(a=f"max(c) OVER {ORD}", z=f"min(c) OVER {ORD}", s=f"sum(v) OVER {ORD}", p=f"sum(ln(1 + 0.001 * c)) OVER {ORD}").out("a", "z", "s", "p"))
indicator("difference_ratio", 6, lambda f: f.add(a=c("close") - f.lag(c("close"), 5), z=c("close") / f.lag(c("close"), 5)), ["a", "z"],
          Sql().add(a=f"c - {lag('c', 5)}", z=f"c / {lag('c', 5)}").out("a", "z"))
indicator("forward_return", 0, lambda f: f.add(y=f.lead(c("close"), 6) / c("close") - 1), ["y"], Sql().add(y=f"lead(c, 6) OVER {ORD} / c - 1").out("y"), ahead=6)
indicator("percent_rank_window", 30, lambda f: f.add(a=R.percent_rank(f, "close", 30), z=R.percent_rank(f, "close", 30, strict=True, prior=True)), ["a", "z"],
          Sql().add(w=f"list(c) OVER {win(30)}", q=f"list(c) OVER {win(30, 1)}").add(
              a="len(list_filter(w, lambda x: x <= c)) / len(w)::DOUBLE", z="CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: x < c)) / len(q)::DOUBLE END").out("a", "z"))


def _ar1(f):
    f = f.add(_p=f.lag(c("close")))
    w = f.rows(100)
    return f.add(y=R.ratio(F.covar_pop("close", "_p").over(w), F.when(F.count("_p").over(w) == 100, F.var_pop("_p").over(w))))


indicator("rolling_ar1", 101, _ar1, ["y"], Sql().add(p=lag("c")).add(y=full("covar_pop(c, p)", "p", 100) + " / " + f"nullif(var_pop(CASE WHEN p IS NOT NULL THEN p END) OVER {win(100)}, 0)").out("y"))


@query("sorted_trades", f"WITH {B} SELECT symbol, ts, c AS close FROM b ORDER BY ts, symbol")
def sorted_trades(spark, d):
    return T.bars(spark, d).select("symbol", "ts", "close").orderBy("ts", "symbol")


# -- cross-section ----------------------------------------------------------
@query("rank_normalize", f"WITH {B} SELECT symbol, idx, {sr('(row_number() OVER (ORDER BY c, symbol, idx) - 1) / (count(*) OVER () - 1)::DOUBLE', 9)} AS score01 FROM b")
def rank_normalize(spark, d):
    b = T.bars(spark, d).select("symbol", "idx", "close")
    return rounded(X.rank_normalize(b, "close", ["symbol", "idx"]), ["symbol", "idx"], ["score01"], 9)


_PANEL = f"""WITH {BR}, p AS (SELECT symbol, (ts - 345600000) // 604800000 AS day, c AS signal, v FROM b)"""


def _panel(spark, d):
    return T.brands(spark, d).select("symbol", F.floor((c("ts") - T.MONDAY_MS) / WEEK_MS).alias("day"), c("close").alias("signal"), c("volume").alias("v"))


_BOOK = f"""{_PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY signal DESC, symbol) AS u, row_number() OVER (PARTITION BY day ORDER BY signal, symbol) AS dn, count(*) OVER (PARTITION BY day) AS n FROM p WHERE day % 4 = 0),
k AS (SELECT day AS rd, symbol, CASE WHEN u <= 5 THEN -0.2 WHEN dn <= 5 THEN 0.2 ELSE 0 END AS w FROM r WHERE n >= 10),
q AS (SELECT p.symbol, p.day, coalesce(k.w, 0)::DOUBLE AS w FROM p LEFT JOIN k ON k.symbol = p.symbol AND k.rd = p.day // 4 * 4)"""


@query("top_bottom_book", _BOOK + " SELECT symbol, day, w FROM q")
def top_bottom_book(spark, d):
    return X.top_bottom_book(_panel(spark, d), 5, 4).select("symbol", "day", "w")


@query("book_turnover", _BOOK + f""", m AS (SELECT day, symbol, w FROM q WHERE w <> 0 UNION ALL SELECT day + 1, symbol, -w FROM q WHERE w <> 0), z AS (SELECT day, symbol, sum(w) AS dw FROM m GROUP BY 1, 2)
SELECT t.day, {sr('coalesce(sum(abs(dw)), 0)')} AS turnover FROM (SELECT DISTINCT day FROM q) t LEFT JOIN z USING (day) GROUP BY t.day""")
def book_turnover(spark, d):
    return rounded(X.turnover(X.top_bottom_book(_panel(spark, d), 5, 4)), ["day"], ["turnover"])


@query("book_similarity", _BOOK + f""", m AS (SELECT DISTINCT day, symbol FROM q WHERE w > 0), n AS (SELECT day, count(*) AS n FROM m GROUP BY 1), kk AS (SELECT a.day, count(*) AS k FROM m a JOIN m z ON z.day = a.day - 1 AND z.symbol = a.symbol GROUP BY 1)
SELECT n.day, {sr('coalesce(k, 0) / (n.n + p.n - coalesce(k, 0))::DOUBLE')} AS jaccard FROM n JOIN n p ON p.day = n.day - 1 LEFT JOIN kk ON kk.day = n.day""")
def book_similarity(spark, d):
    return rounded(X.set_similarity(X.top_bottom_book(_panel(spark, d), 5, 4).filter("w > 0")), ["day"], ["jaccard"])


@query("fraction_weights", _PANEL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY signal, symbol) AS k, count(*) OVER (PARTITION BY day) AS n FROM p)
SELECT symbol, day, {sr('''CASE WHEN n < 5 THEN 0 WHEN k <= greatest(floor(n * 0.2), 1) THEN 1 / greatest(floor(n * 0.2), 1) WHEN k > n - greatest(floor(n * 0.2), 1) THEN -1 / greatest(floor(n * 0.2), 1) ELSE 0 END''')} AS w FROM r""")
def fraction_weights(spark, d):
    return rounded(X.fraction_weights(_panel(spark, d), z="signal"), ["symbol", "day"], ["w"])


@query("daily_terciles", _PANEL + """, q AS (SELECT day, quantile_cont(signal, 1.0 / 3) AS a, quantile_cont(signal, 2.0 / 3) AS z FROM p GROUP BY day)
SELECT symbol, day, CASE WHEN signal <= a THEN 1 WHEN signal <= z THEN 2 ELSE 3 END AS tercile FROM p JOIN q USING (day)""")
def daily_terciles(spark, d):
    return X.terciles(_panel(spark, d), ["day"], "signal").select("symbol", "day", "tercile")


@query("decile_ladder", f"""WITH {B}, e AS (SELECT quantile_cont(c, [{', '.join(f'{i / 10}' for i in range(1, 10))}]) AS q FROM b), k AS (SELECT len(list_filter(q, lambda x: x <= c)) AS bucket, v FROM b, e)
SELECT bucket::INTEGER AS bucket, count(*) AS n, {sr('avg(v)')} AS mean_y FROM k GROUP BY 1""")
def decile_ladder(spark, d):
    return rounded(X.deciles(T.bars(spark, d), "close", "volume"), ["bucket", "n"], ["mean_y"])


@query("top_shares", f"""WITH {B}, r AS (SELECT v, row_number() OVER (ORDER BY -c, symbol, idx) - 1 AS k, count(*) OVER () AS n FROM b), q AS (SELECT unnest([0.01, 0.05, 0.1, 0.5])::DOUBLE AS q)
SELECT q, count(*) AS n, {sr('avg(v)')} AS mean_y FROM r, q WHERE k < greatest(floor(r.n * q), 1) GROUP BY q""")
def top_shares(spark, d):
    return rounded(X.top_share(T.bars(spark, d).select("symbol", "idx", "close", "volume"), "close", ["symbol", "idx"], "volume", [0.01, 0.05, 0.1, 0.5]), ["q", "n"], ["mean_y"])


@query("ev_threshold", f"""WITH {B}, x AS (SELECT c AS p, v - 3.1 AS r FROM b), t AS (SELECT unnest(quantile_cont(p, [{', '.join(str(i / 20) for i in range(20))}])) AS thr FROM x),
e AS (SELECT thr, count(*) AS n, avg(r) AS ev FROM t JOIN x ON x.p >= t.thr GROUP BY thr)
SELECT {sr('thr')} AS threshold, {sr('ev')} AS ev, n FROM e WHERE ev > 0 ORDER BY round(e.ev, 12) DESC, thr LIMIT 1""")
def ev_threshold(spark, d):
    b = T.bars(spark, d).select(c("close").alias("p"), (c("volume") - 3.1).alias("r"))
    return X.ev_threshold(b, "p", "r").select(r6("threshold").alias("threshold"), r6("ev").alias("ev"), "n")


@query("quantile_report", "SELECT event_type AS symbol, " + ", ".join(f"{sr(f'quantile_cont(value, {q / 100})')} AS p{q}" for q in (50, 75, 90, 95, 99)) + " FROM events GROUP BY 1")
def quantile_report(spark, d):
    e = T.table(spark, d, "events").groupBy(c("event_type").alias("symbol")).agg(F.percentile("value", F.array(*[F.lit(q) for q in (0.5, 0.75, 0.9, 0.95, 0.99)])).alias("q"))
    return e.select("symbol", *[r6(c("q")[i]).alias(f"p{n}") for i, n in enumerate((50, 75, 90, 95, 99))])


@query("value_counts", "SELECT event_type, user_id % 3 AS cls, count(*) AS n FROM events GROUP BY 1, 2")
def value_counts(spark, d):
    return T.table(spark, d, "events").groupBy("event_type", (c("user_id") % 3).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("funnel_counts", "SELECT event_type, count(*) AS seen, count_if(value > 10)::BIGINT AS priced, count_if(value > 10 AND user_id > 20)::BIGINT AS known, count_if(value > 10 AND user_id > 20 AND value < 100)::BIGINT AS kept FROM events GROUP BY 1")
def funnel_counts(spark, d):
    a, b, z = c("value") > 10, c("user_id") > 20, c("value") < 100
    return T.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("seen"), F.count_if(a).alias("priced"), F.count_if(a & b).alias("known"), F.count_if(a & b & z).alias("kept"))


@query("bucketed_medians", f"SELECT floor(l_discount / 0.02)::BIGINT AS bucket, {sr('median(l_extendedprice / l_quantity)')} AS med, count(*) AS n FROM lineitem GROUP BY 1")
def bucketed_medians(spark, d):
    li = T.table(spark, d, "lineitem")
    g = li.groupBy(F.floor(c("l_discount") / 0.02).alias("bucket")).agg(F.percentile(c("l_extendedprice") / c("l_quantity"), 0.5).alias("med"), F.count(F.lit(1)).alias("n"))
    return rounded(g, ["bucket", "n"], ["med"])


@query("interpolation_table", f"WITH {B} SELECT symbol, idx, {sr('CASE WHEN c <= 10 THEN 1 WHEN c < 50 THEN 1 + (c - 10) * 2 / 40 WHEN c < 200 THEN 3 - (c - 50) / 150 ELSE 2 END')} AS y FROM b")
def interpolation_table(spark, d):
    return T.bars(spark, d).select("symbol", "idx", r6(X.piecewise(c("close"), [(10.0, 1.0), (50.0, 3.0), (200.0, 2.0)])).alias("y"))


@query("chronological_segments", f"WITH {B}, m AS (SELECT *, max(idx) OVER (PARTITION BY symbol) + 1 AS n FROM b) SELECT symbol, CASE WHEN idx < floor(n * 2 / 3) THEN 'PRIMARY' ELSE 'F3' END AS seg, count(*) AS n, {sr('avg(c)')} AS ev FROM m GROUP BY 1, 2")
def chronological_segments(spark, d):
    b = T.bars(spark, d)
    n = b.groupBy("symbol").agg((F.max("idx") + 1).alias("_n"))
    g = b.join(n, "symbol").groupBy("symbol", F.when(c("idx") < F.floor(c("_n") * 2 / 3), "PRIMARY").otherwise("F3").alias("seg")).agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("ev"))
    return rounded(g, ["symbol", "seg", "n"], ["ev"])


@query("pair_correlations", f"""WITH {BR}, d AS (SELECT symbol, ts, c FROM b QUALIFY count(*) OVER (PARTITION BY ts) = (SELECT count(DISTINCT symbol) FROM b)) SELECT a.symbol AS a, z.symbol AS b, {sr('corr(a.c, z.c)', 5)} AS rho FROM d a JOIN d z USING (ts) GROUP BY 1, 2""")
def pair_correlations(spark, d):
    from ..plans.spectra import correlations

    b = T.brands(spark, d).select("symbol", "ts", c("close").alias("r"))
    full_days = RS.common_buckets(b, "ts")
    half = settled(correlations(full_days, "ts", "symbol", "r", fill=None).select("a", "b", r6("rho", 5).alias("rho")))
    return half.unionByName(half.filter("a != b").select(c("b").alias("a"), c("a").alias("b"), "rho"))


@query("point_in_time_universe", """SELECT epoch_ms(d) // 86400000 AS day, count(*) AS n FROM (SELECT DISTINCT date_trunc('month', l_shipdate) AS d FROM lineitem) x JOIN
 (SELECT l_suppkey, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY 1) s ON s.a <= d AND d <= s.z GROUP BY 1""")
def point_in_time_universe(spark, d):
    li = T.table(spark, d, "lineitem")
    months = li.select(F.date_trunc("month", c("l_shipdate").cast("timestamp")).cast("timestamp").alias("d")).distinct()
    life = li.groupBy("l_suppkey").agg(F.date_trunc("month", F.min("l_shipdate")).alias("m0"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z"))
    # each listing is expanded to its own months, then matched on the month
    alive = life.select("a", "z", F.explode(F.expr("sequence(cast(m0 as date), cast(z as date), interval 1 month)")).alias("d")).withColumn("d", c("d").cast("timestamp"))
    hit = alive.join(months, "d").filter((c("a") <= c("d")) & (c("d") <= c("z")))
    return hit.groupBy((F.unix_millis("d") / DAY_MS).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("liquidity_universe", f"""WITH {BR}, g AS (SELECT symbol, count(*) AS age, median(v) AS med FROM b GROUP BY 1) SELECT symbol, age, med FROM g WHERE age >= 300 AND med >= 10 ORDER BY med DESC, symbol LIMIT 10""")
def liquidity_universe(spark, d):
    g = T.brands(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("age"), F.percentile("volume", 0.5).alias("med"))
    return g.filter("age >= 300 and med >= 10").orderBy(c("med").desc(), "symbol").limit(10)


@query("tick_lot_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 0.25) * 0.25 AS px, floor(l_quantity / 3) * 3 AS qty FROM lineitem")
def tick_lot_rounding(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(c("l_extendedprice") / 0.25) * 0.25).alias("px"), (F.floor(c("l_quantity") / 3) * 3).cast("double").alias("qty"))
