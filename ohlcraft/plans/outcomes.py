"""What happened after an event: stop, target or time exit, excursions, labels.

Events are rows ``(symbol, idx, is_long, …)``; bars are numbered. Every operator pairs
events with later bars through :func:`bars_between` and reduces per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import Frame
from ..operators.intervals import bars_between

c = F.col


def is_long() -> Column:
    return F.col("is_long")


def sign() -> Column:
    return F.when(F.col("is_long"), 1.0).otherwise(-1.0)


def touches(events: DataFrame, bars: DataFrame, ids: list[str], first: Column, last: Column, horizon: int) -> DataFrame:
    """First bar in ``[first, last]`` that reaches ``stop`` or ``target``; the stop wins inside a bar.

    Adds ``hit_idx``, ``hit`` ('sl'/'tp'/NULL), and the last bar seen with its close.
    """
    pairs = bars_between(events, bars, first, last, max(64, horizon), ["high", "low", "close"])
    at_stop = F.when(is_long(), c("b_low") <= c("stop")).otherwise(c("b_high") >= c("stop"))
    at_target = F.when(is_long(), c("b_high") >= c("target")).otherwise(c("b_low") <= c("target"))
    hit = F.when(at_stop, F.struct(c("b_idx"), F.lit(0).alias("kind"))).when(at_target, F.struct(c("b_idx"), F.lit(1).alias("kind")))
    seen = pairs.groupBy(*ids).agg(
        F.min(hit).alias("_h"), F.max("b_idx").alias("last_idx"), F.max_by("b_close", "b_idx").alias("last_close"),
    )
    kind = F.when(c("_h.kind") == 0, "sl").when(c("_h.kind") == 1, "tp")
    return events.join(seen, ids, "left").withColumns({"hit_idx": c("_h.b_idx"), "hit": kind}).drop("_h")


def r_exit(events: DataFrame, bars: DataFrame, ids: list[str], target_r: Column | float, horizon: int,
           fee: float = 0.0005) -> DataFrame:
    """Stop at −1R, target at ``target_r``, otherwise the close ``horizon`` bars later (or the last one).

    Needs ``close`` and ``risk`` on the events. Adds ``gross``, ``fee``, ``net``, ``exit_idx``, ``reason``.
    """
    goal = F.lit(target_r) if isinstance(target_r, (int, float)) else target_r
    ev = events.withColumns({"stop": c("close") - sign() * c("risk"), "target": c("close") + sign() * goal * c("risk"), "_goal": goal})
    out = touches(ev, bars, ids, c("idx") + 1, c("idx") + horizon, horizon)
    timed = sign() * (F.coalesce("last_close", "close") - c("close")) / c("risk")
    gross = F.when(c("hit") == "sl", -1.0).when(c("hit") == "tp", c("_goal").cast("double")).otherwise(timed)
    return out.withColumns({
        "gross": gross, "fee": 2 * fee * c("close") / c("risk"),
        "exit_idx": F.coalesce("hit_idx", "last_idx", "idx"), "reason": F.coalesce("hit", F.lit("time")),
    }).withColumn("net", c("gross") - c("fee")).drop("_goal", "hit_idx", "hit", "last_idx", "last_close")


def barrier_outcome(events: DataFrame, bars: DataFrame, ids: list[str], hold: int, commission: float, slippage: float) -> DataFrame:
    """Outcome from ``fill_idx`` at ``fill`` with slippage on stop and time exits, costs in R.

    The time exit is ``hold`` bars after the fill; a trade still open at the end has no outcome.
    """
    ev = events.withColumn("risk_unit", F.abs(c("fill") - c("stop")))
    out = touches(ev, bars, ids, c("fill_idx"), c("fill_idx") + hold, hold)
    cost = (2 * commission + slippage) * c("fill") / c("risk_unit")
    timed = c("hit").isNull() & (c("last_idx") == c("fill_idx") + hold)
    price = (
        F.when(c("hit") == "sl", c("stop") * (1 - sign() * slippage))
        .when(c("hit") == "tp", c("target"))
        .when(timed, c("last_close") * (1 - sign() * slippage))
    )
    ok = c("risk_unit") > 0
    return out.withColumns({
        "exit_price": F.when(ok, price),
        "exit_idx": F.when(ok, F.coalesce("hit_idx", F.when(timed, c("last_idx")))),
        "exit_reason": F.when(ok, F.coalesce("hit", F.when(timed, F.lit("time")))),
    }).withColumn("r_net", sign() * (c("exit_price") - c("fill")) / F.nullif("risk_unit", F.lit(0.0)) - F.when(ok, cost)).drop(
        "hit_idx", "hit", "last_idx", "last_close")


def pessimistic(df: DataFrame, slip: float = 0.0005, gap: float = 0.25, entry_mult: float = 2.0, exit_mult: float = 2.0,
                out: str = "r_pess") -> DataFrame:
    """Worse fills: more entry slippage, and on stops also more exit slippage and a gap in ATR."""
    entry = entry_mult * slip * c("fill") / c("risk_unit")
    extra = (exit_mult - 1) * slip
    exit_ = F.when(c("exit_reason") == "sl", extra * F.abs("stop") / c("risk_unit") + gap * c("atr") / c("risk_unit")).when(
        c("exit_reason") == "time", extra * F.abs("exit_price") / c("risk_unit")).otherwise(0.0)
    return df.withColumn(out, c("r_net") - entry - exit_)


def maker_outcome(events: DataFrame, bars: DataFrame, ids: list[str], hold: int = 48, maker_frac: float = 0.3,
                  commission: float = 0.001, slip: float = 0.0005, gap: float = 0.25) -> DataFrame:
    """Resting-order entry: part of the fee on the entry side, pessimistic exits, at most ``hold`` bars."""
    ev = events.withColumn("risk_unit", F.abs(c("fill") - c("stop")))
    out = touches(ev, bars, ids, c("fill_idx"), c("fill_idx") + hold - 1, hold)
    k = c("risk_unit")
    cost = (commission * (1 + maker_frac) + slip) * c("fill") / k
    entry = 2 * slip * c("fill") / k
    beyond = sign() * (c("fill") - c("stop")) < 0
    px = c("last_close") * (1 - sign() * slip)
    timed = c("last_idx") == c("fill_idx") + hold - 1
    value = (
        F.when(beyond, -cost - entry - slip * F.abs("fill") / k)
        .when(c("hit") == "sl", sign() * (c("stop") * (1 - sign() * slip) - c("fill")) / k - cost - entry - slip * F.abs("stop") / k - gap * c("atr") / k)
        .when(c("hit") == "tp", sign() * (c("target") - c("fill")) / k - cost - entry)
        .when(timed, sign() * (px - c("fill")) / k - cost - entry - slip * F.abs(px) / k)
    )
    return out.withColumn("r_pess", F.when(k > 0, value)).drop("hit_idx", "hit", "last_idx", "last_close")


def reverse_exit(events: DataFrame, bars: DataFrame, horizon: int = 500, fee: float = 0.0005) -> DataFrame:
    """Exit at the next opposite event (at most ``horizon`` bars on, the last bar if there is none), hard stop before.

    Events are unique per ``(symbol, idx)``; a pair of them is matched through the as-of operator.
    """
    from ..operators.asof import asof

    ids = ["symbol", "idx"]
    opposite = events.select("symbol", c("idx").alias("_n"), "is_long")
    halves = []
    for side in (True, False):
        nxt = opposite.filter(~c("is_long") if side else c("is_long")).select("symbol", (c("_n") - 1).alias("_at"), "_n")
        halves.append(asof(events.filter(c("is_long") == side), nxt, "idx", "_at", ["_n"], span=1024, forward=True))
    ev = halves[0].unionByName(halves[1])
    last = bars.groupBy("symbol").agg(F.max("idx").alias("_last"))
    ev = ev.join(last, "symbol").withColumn("_out", F.when(c("_n").isNull(), c("_last")).otherwise(F.least("_n", c("idx") + horizon)))
    ev = ev.withColumn("_out", F.least("_out", "_last")).withColumns({
        "stop": c("close") - sign() * c("risk"), "target": F.lit(None).cast("double")})
    hits = touches(ev, bars, ids, c("idx") + 1, c("_out"), horizon)
    gross = F.when(c("hit") == "sl", -1.0).otherwise(sign() * (F.coalesce("last_close", "close") - c("close")) / c("risk"))
    return hits.withColumns({
        "gross": gross, "net": gross - 2 * fee * c("close") / c("risk"), "exit_idx": F.coalesce("hit_idx", "_out"),
        "reason": F.when(c("hit") == "sl", "sl").otherwise("reverse"),
    }).drop("hit_idx", "hit", "last_idx", "last_close", "_n", "_last", "_out", "target")


def trailing_exit(events: DataFrame, bars: DataFrame, horizon: int, trail: Column, fee: float = 0.0005) -> DataFrame:
    """Stop that follows the best price by ``trail`` (read on the event), never loosening.

    The stop in force at a bar uses the bars before it, so it is a running extreme inside the event.
    """
    from pyspark.sql import Window

    ids = ["symbol", "idx"]
    ev = events.withColumns({"_trail": trail, "_stop0": c("close") - sign() * c("risk")})
    pairs = bars_between(ev, bars, c("idx") + 1, c("idx") + horizon, max(64, horizon), ["high", "low", "close"])
    before = Window.partitionBy(*ids).orderBy("b_idx").rowsBetween(Window.unboundedPreceding, -1)
    best = F.when(is_long(), F.max("b_high").over(before) - c("_trail")).otherwise(F.min("b_low").over(before) + c("_trail"))
    pairs = pairs.withColumn("_s", F.when(is_long(), F.greatest("_stop0", best)).otherwise(F.least("_stop0", best)))
    out_at = F.when(is_long(), c("b_low") <= c("_s")).otherwise(c("b_high") >= c("_s"))
    seen = pairs.groupBy(*ids).agg(
        F.min(F.when(out_at, F.struct("b_idx", "_s"))).alias("_x"), F.max("b_idx").alias("_li"), F.max_by("b_close", "b_idx").alias("_lc"))
    out = ev.join(seen, ids, "left")
    price = F.coalesce("_x._s", "_lc", "close")
    gross = sign() * (price - c("close")) / c("risk")
    return out.withColumns({
        "exit_idx": F.coalesce("_x.b_idx", "_li", "idx"), "exit_price": price, "gross": gross,
        "net": gross - 2 * fee * c("close") / c("risk"), "reason": F.when(c("_x").isNotNull(), "trail").otherwise("time"),
    }).drop("_trail", "_stop0", "_x", "_li", "_lc")


def excursions(events: DataFrame, bars: DataFrame, ids: list[str], hold: int) -> DataFrame:
    """Best and worst move from ``fill_idx`` on, up to the bar before the stop is hit, in ATR and R."""
    pairs = bars_between(events, bars, c("fill_idx"), c("fill_idx") + hold - 1, max(64, hold), ["high", "low"])
    stopped = F.when(is_long(), c("b_low") <= c("stop")).otherwise(c("b_high") >= c("stop"))
    cut = pairs.groupBy(*ids).agg(F.min(F.when(stopped, c("b_idx"))).alias("_cut"))
    live = pairs.join(cut, ids).filter(c("_cut").isNull() | (c("b_idx") < c("_cut")))
    up = F.when(is_long(), c("b_high") - c("fill")).otherwise(c("fill") - c("b_low"))
    dn = F.when(is_long(), c("fill") - c("b_low")).otherwise(c("b_high") - c("fill"))
    best = live.groupBy(*ids).agg(F.greatest(F.max(up), F.lit(0.0)).alias("_f"), F.greatest(F.max(dn), F.lit(0.0)).alias("_a"))
    risk = F.abs(c("fill") - c("stop"))
    ok = (risk > 0) & (c("atr") > 0)
    fav, adv = F.coalesce("_f", F.lit(0.0)), F.coalesce("_a", F.lit(0.0))
    return events.join(best, ids, "left").withColumns({
        "mfe_atr": F.when(ok, fav / c("atr")), "mae_atr": F.when(ok, adv / c("atr")),
        "mfe_r": F.when(ok, fav / F.nullif(risk, F.lit(0.0))), "mae_r": F.when(ok, adv / F.nullif(risk, F.lit(0.0))),
    }).drop("_f", "_a")


def mfe_mae(signals: DataFrame, bars: DataFrame, side: str = "long", horizon: int = 24, entry: str = "next_open",
            sl_atr: float = 1.0, incomplete: str = "partial", stop_exit: bool = False) -> DataFrame:
    """Maximum favourable and adverse excursion of each signal row ``(symbol, idx, ts, close, atr)``.

    ``entry`` is ``next_open`` or ``signal_close``; ``incomplete='drop'`` removes signals whose horizon
    runs past the data; ``stop_exit`` ends the walk on the bar that touches the stop.
    """
    nxt = bars.select("symbol", (c("idx") - 1).alias("idx"), c("open").alias("_no"), c("ts").alias("_nts"))
    last = bars.groupBy("symbol").agg(F.max("idx").alias("_last"))
    ev = signals.join(last, "symbol")
    if entry == "next_open":
        ev = ev.join(nxt, ["symbol", "idx"]).withColumns({"entry_idx": c("idx") + 1, "entry_price": c("_no"), "entry_ts": c("_nts")})
        start = c("entry_idx")
    else:
        ev = ev.withColumns({"entry_idx": c("idx"), "entry_price": c("close"), "entry_ts": c("ts")})
        start = c("entry_idx") + 1
    if incomplete == "drop":
        ev = ev.filter(start + horizon - 1 <= c("_last"))
    way = 1.0 if side == "long" else -1.0
    ev = ev.withColumn("stop", c("entry_price") - way * sl_atr * c("atr"))
    ids = ["symbol", "idx"]
    pairs = bars_between(ev, bars, start, start + horizon - 1, max(64, horizon), ["high", "low"])
    touched = c("b_low") <= c("stop") if side == "long" else c("b_high") >= c("stop")
    cut = pairs.groupBy(*ids).agg(F.min(F.when(touched, c("b_idx"))).alias("_cut"))
    walk = pairs.join(cut, ids)
    if stop_exit:
        walk = walk.filter(c("_cut").isNull() | (c("b_idx") <= c("_cut")))
    up, dn = c("b_high") - c("entry_price"), c("entry_price") - c("b_low")
    fav, adv = (up, dn) if side == "long" else (dn, up)
    stats = walk.groupBy(*ids).agg(
        F.greatest(F.max(fav), F.lit(0.0)).alias("mfe_abs"), F.greatest(F.max(adv), F.lit(0.0)).alias("mae_abs"),
        F.count(F.lit(1)).alias("bars_measured"), F.max(c("_cut").isNotNull()).alias("sl_hit"))
    out = ev.join(stats, ids, "left").fillna({"mfe_abs": 0.0, "mae_abs": 0.0, "bars_measured": 0, "sl_hit": False})
    atr = F.nullif("atr", F.lit(0.0))
    return out.select(
        "symbol", c("ts").alias("signal_ts"), "entry_ts", "entry_idx", "entry_price", "bars_measured", "mfe_abs", "mae_abs",
        (c("mfe_abs") / atr).alias("mfe_atr"), (c("mae_abs") / atr).alias("mae_atr"),
        (c("mfe_abs") / (sl_atr * atr)).alias("mfe_r"), (c("mae_abs") / (sl_atr * atr)).alias("mae_r"), "sl_hit")


def limit_fill(events: DataFrame, bars: DataFrame, ids: list[str], level: Column, wait: int = 5, buf_atr: float = 0.1) -> DataFrame:
    """First of the next ``wait`` bars that trades through the level by a buffer; adds ``fill_idx``."""
    ev = events.withColumn("_lv", level)
    pairs = bars_between(ev, bars, c("idx") + 1, c("idx") + wait, 64, ["high", "low", "atr"])
    buf = buf_atr * F.coalesce("b_atr", F.lit(0.0))
    hit = F.when(is_long(), c("b_low") <= c("_lv") - buf).otherwise(c("b_high") >= c("_lv") + buf)
    fills = pairs.filter(hit).groupBy(*ids).agg(F.min("b_idx").alias("fill_idx"))
    return ev.drop("_lv").join(fills, ids, "left")


def barrier_labels(f: Frame, tp: float, sl: float, hold: int = 48) -> Frame:
    """For every bar and both sides: 1 when the target comes strictly before the stop within ``hold`` bars.

    Entry at the next open, distances in ATR. Forward windows keep this to one pass for short holds.
    """
    f = f.add(_e=f.lead(c("open"), 1))
    path = F.collect_list(F.struct("high", "low")).over(f.next_rows(hold))
    f = f.add(_path=path)

    def first(cond) -> Column:
        flags = F.transform("_path", lambda b: F.when(cond(b), 1).otherwise(0))
        at = F.array_position(flags, 1)
        return F.when(at > 0, at).otherwise(hold + 1)

    t, s = tp * c("atr"), sl * c("atr")
    known = c("_e").isNotNull() & c("atr").isNotNull()
    up_t, up_s = first(lambda b: b["high"] >= c("_e") + t), first(lambda b: b["low"] <= c("_e") - s)
    dn_t, dn_s = first(lambda b: b["low"] <= c("_e") - t), first(lambda b: b["high"] >= c("_e") + s)
    return f.add(long_label=F.when(known, (up_t < up_s).cast("int")), short_label=F.when(known, (dn_t < dn_s).cast("int")))


def direction_labels(f: Frame, ahead: int = 24, threshold: float = 0.02) -> Frame:
    ret = f.lead(c("close"), ahead) / c("close") - 1
    f = f.add(fwd_ret=ret)
    return f.add(label=F.when(c("fwd_ret") > threshold, 1).when(c("fwd_ret") < -threshold, -1).when(c("fwd_ret").isNotNull(), 0))


def stop_levels(rows: DataFrame, rules: list[str], targets: list[float], min_risk_atr: float = 1.0) -> DataFrame:
    """Cross the rows with the rule table: stop and target of ``zone:k``, ``atr:m`` and ``anchor:name:k``.

    Anchor columns are ``a_avsl, a_avsr, a_hilo_l, a_hilo_s, a_st, a_bb_l, a_bb_u``; a rule that does not
    serve the side, or risks less than ``min_risk_atr``, gives NULL levels.
    """
    per_rule = []
    for rule in rules:
        kind, *rest = rule.split(":")
        k = float(rest[-1])
        if kind == "atr":
            base, dist = c("close"), k
        elif kind == "zone":
            base, dist = c("zone"), k
        elif kind == "anchor":
            base = F.when(is_long(), _anchor(rest[0], True)).otherwise(_anchor(rest[0], False))
            dist = k
        else:
            raise ValueError(f"unknown stop rule {rule!r}")
        per_rule.append(F.struct(F.lit(rule).alias("rule"), (base - sign() * dist * c("atr")).alias("stop")))
    grid = rows.withColumn("_r", F.explode(F.array(*per_rule))).withColumn("target_r", F.explode(F.array(*[F.lit(t) for t in targets])))
    risk = F.abs(c("close") - c("_r.stop"))
    ok = (risk > 0) & (risk >= min_risk_atr * c("atr"))
    return grid.withColumns({
        "rule": c("_r.rule"), "stop": F.when(ok, c("_r.stop")),
        "target": F.when(ok, c("close") + sign() * c("target_r") * risk)}).drop("_r")


_SIDES = {"avsl": ("a_avsl", None), "avsr": (None, "a_avsr"), "hilo": ("a_hilo_l", "a_hilo_s"), "st": ("a_st", "a_st"), "bb": ("a_bb_l", "a_bb_u")}


def _anchor(name: str, up: bool) -> Column:
    found = _SIDES.get(name, (None, None))[0 if up else 1]
    return c(found) if found else F.lit(None).cast("double")


def atr_levels(f: Frame, tp_mult: float = 2.0, sl_mult: float = 1.5) -> Frame:
    """Target and stop from the previous bar's ATR (the first bar uses its own)."""
    prev = F.coalesce(f.lag(c("atr")), c("atr"))
    f = f.add(_pa=prev)
    return f.add(tp=c("close") + tp_mult * c("_pa"), sl=F.greatest(c("close") - sl_mult * c("_pa"), F.lit(1e-6)))


def gap_through_stop(exits: DataFrame, bars: DataFrame) -> DataFrame:
    """Stop exits whose bar opened beyond the stop."""
    opens = bars.select("symbol", c("idx").alias("exit_idx"), c("open").alias("_o"))
    hit = exits.filter(c("reason") == "sl").join(opens, ["symbol", "exit_idx"])
    beyond = F.when(is_long(), c("_o") < c("stop")).otherwise(c("_o") > c("stop"))
    return hit.groupBy("symbol").agg(F.count(F.lit(1)).alias("stops"), F.count_if(beyond).alias("gapped"),
                                     F.max(F.when(beyond, F.abs(c("_o") - c("stop")) / c("risk"))).alias("worst_r"))
