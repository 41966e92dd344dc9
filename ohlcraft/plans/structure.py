"""Market structure: pivots, order blocks, zones and the entries they produce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.averages import rma
from ..functions.momentum import macd_of, rsi_of
from ..functions.rolling import c, expanding_mean, mean, ratio, rolling_max, rolling_min
from ..functions.volatility import adx as adx_ind
from ..functions.volatility import atr as atr_ind
from ..operators import kernels as K
from ..operators.fold import fold
from ..operators.frames import Frame, number_bars, ordinals
from ..operators.intervals import bars_between
from ..operators.ladder import Ladder, first_crossing
from ..operators.scan import asof_sorted
from ..operators.stabbing import covering, live_zones
from ..operators.running import running
from ..sources.store import settled

ZONE_CHUNK = 256


# -- pivots -----------------------------------------------------------------
def pivots(numbered: DataFrame, reversal: float, share: float | None = None) -> DataFrame:
    """Confirmed pivots ``(symbol, idx, price, kind, confirm_idx, n)``; ``n`` counts them per symbol."""
    rows = fold(numbered, K.zigzag(reversal, share), ["idx", "high", "low"],
                {"pivot_idx": "long", "pivot_price": "double", "pivot_kind": "long"})
    found = rows.filter("pivot_kind != 0").select(
        "symbol", c("pivot_idx").alias("_p"), c("pivot_price").alias("price"), c("pivot_kind").alias("kind"), c("idx").alias("confirm_idx"))
    return number_bars(found, 1, ts="confirm_idx").withColumnRenamed("idx", "n").withColumnRenamed("_p", "idx")


def with_neighbours(piv: DataFrame) -> DataFrame:
    """Add the next pivot and the previous ones (kinds alternate: one back is the other kind, two back the same)."""
    f = Frame.of_numbered(piv.withColumnRenamed("idx", "_p").withColumnRenamed("n", "idx"), 4, 1)
    cols = {"next_idx": f.lead(c("_p")), "next_confirm": f.lead(c("confirm_idx"))}
    for k in range(1, 5):
        cols[f"price_{k}"] = f.lag(c("price"), k)
    return f.add(**cols).core().withColumnRenamed("idx", "n").withColumnRenamed("_p", "idx")


def structure_labels(piv: DataFrame, min_consecutive: int = 3) -> DataFrame:
    """HH/LH and HL/LL against the last two pivots of each kind known at a pivot, and the trend they agree on.

    Known at pivot n are the pivots up to n-1; the last is of the other kind.
    """
    p = with_neighbours(piv)
    peak_up = F.when(c("kind") == 1, c("price_2") > c("price_4")).otherwise(c("price_1") > c("price_3"))
    valley_up = F.when(c("kind") == 1, c("price_1") > c("price_3")).otherwise(c("price_2") > c("price_4"))
    known = c("price_4").isNotNull()
    label = F.concat_ws("/", F.when(peak_up, "HH").otherwise("LH"), F.when(valley_up, "HL").otherwise("LL"))
    last_up = F.when(c("kind") == 1, valley_up).otherwise(peak_up)
    up, down = (last_up, ~last_up) if min_consecutive == 1 else (peak_up & valley_up, ~peak_up & ~valley_up)
    return p.withColumns({"structure_label": F.when(known, label), "trend_direction": F.when(known & up, "up").when(known & down, "down")})


# -- order blocks -----------------------------------------------------------
@dataclass(frozen=True)
class BlockConfig:
    """Parameters of the order-block plan; the defaults are the published ones."""

    reversal: float | None = 0.01
    reversal_pct: float | None = None
    reversal_atr: float | None = None
    warmup_bars: int = 500
    lookback_min: int = 5
    lookback_max: int = 50
    min_gap: int = 0
    complete_window: bool = False
    volume_threshold: float = 1.0
    impulse: float = 0.0
    adx_n: int | None = None
    adx_threshold: float = 25.0
    structure_filter: bool = False
    min_consecutive: int = 3
    max_age: int = 0
    fvg: bool = False
    fvg_tolerance: float = 0.0
    fvg_volume: float = 0.0
    fvg_mode: str = "any"
    fvg_bonus: float = 1.0
    breaker: bool = False
    breaker_lookback: int = 50
    breaker_bonus: float = 1.5
    breaker_displacement: bool = False
    flow_shift: bool = False
    shift_needs_extremes: bool = True
    entry_mode: str = "wick"
    closure_outside: bool = False
    zone_intact: bool = True
    displacement: float = 0.0
    rsi: tuple[int, float, float] | None = None
    macd: tuple[int, int, int] | None = None
    window: int = 10
    min_reaction: float = 0.002
    penetration: float = 0.5
    atr_n: int = 14
    zone_source: str = "range"
    zone_atr: float = 0.0
    volume_n: int = 20
    liquidity_n: int = 10
    liquidity_tolerance: float = 0.001
    log_volume: bool = False
    atr_normalize: bool = False
    age_penalty: bool = False
    halflife: int = 20
    max_multiplier: float = 10.0
    reaction_cap: float = 3.0
    cluster: bool = False
    cluster_tolerance: float = 0.001
    cluster_gap_ms: int | None = 30 * 86_400_000


def reversal_from_atr(rows: DataFrame, k: float, warmup: int = 500) -> DataFrame:
    """``k`` times the median of the first ``warmup`` ATR values of each symbol."""
    head = rows.filter(c("atr").isNotNull())
    first = head.groupBy("symbol").agg(F.min("idx").alias("_f"))
    return head.join(first, "symbol").filter(c("idx") < c("_f") + warmup).groupBy("symbol").agg((k * F.percentile("atr", 0.5)).alias("reversal"))


def precompute(numbered: DataFrame, cfg: BlockConfig) -> DataFrame:
    """ATR, average volume, local extremes and zone bounds of every bar."""
    back = max(cfg.atr_n + 1, cfg.volume_n, cfg.liquidity_n, 2)
    if cfg.adx_n:
        back = max(back, cfg.adx_n + 2)
    f = atr_ind(Frame.of_numbered(numbered, back), "atr", cfg.atr_n)
    f = f.add(avg_volume=mean(f, "volume", cfg.volume_n), local_high=rolling_max(f, "high", cfg.liquidity_n), local_low=rolling_min(f, "low", cfg.liquidity_n))
    lo, hi = {"range": (c("low"), c("high")), "body": (F.least("open", "close"), F.greatest("open", "close")),
              "close_band": (c("close"), c("close"))}[cfg.zone_source]
    # a zero multiplier still needs the ATR to exist
    f = f.add(zone_low=lo - cfg.zone_atr * c("atr"), zone_high=hi + cfg.zone_atr * c("atr"))
    if cfg.adx_n:
        f = adx_ind(f.settle(), cfg.adx_n)
    if cfg.rsi:
        f = rsi_of(f.settle(), "rsi", "close", cfg.rsi[0])
    if cfg.macd:
        f = macd_of(f.settle(), "close", *cfg.macd).add(macd_hist=c("hist"))
    keep = ["atr", "avg_volume", "local_high", "local_low", "zone_low", "zone_high"]
    keep += (["adx", "dmp", "dmn"] if cfg.adx_n else []) + (["rsi"] if cfg.rsi else []) + (["macd_hist"] if cfg.macd else [])
    return f.core(*numbered.columns, *keep)


def block_candidates(rows: DataFrame, piv: DataFrame, cfg: BlockConfig) -> DataFrame:
    """Pivots whose extreme is taken out, with volume and impulse, ``lookback_min`` to ``lookback_max`` bars later."""
    at = piv.join(rows, ["symbol", "idx"])
    away = F.when(c("kind") == 1, F.abs(c("local_high") - c("high")) >= cfg.liquidity_tolerance * c("high")).otherwise(
        F.abs(c("local_low") - c("low")) >= cfg.liquidity_tolerance * c("low"))
    at = at.filter(~F.coalesce(away, F.lit(False)))
    cols = ["high", "low", "close", "volume", "avg_volume", "atr"] + (["adx", "dmp", "dmn"] if cfg.adx_n else [])
    last = max(cfg.lookback_max, cfg.lookback_min + 1) - 1
    pairs = bars_between(at, rows, c("idx") + cfg.lookback_min, c("idx") + last, max(64, cfg.lookback_max), cols)
    supply = c("kind") == 1
    ok = F.when(supply, c("b_low") < c("low")).otherwise(c("b_high") > c("high"))
    ok = ok & F.coalesce(c("b_volume") > cfg.volume_threshold * c("b_avg_volume"), F.lit(True))
    if cfg.impulse > 0:
        ok = ok & F.coalesce(c("b_high") - c("b_low") >= cfg.impulse * c("b_atr"), F.lit(False))
    if cfg.adx_n:
        ok = ok & F.coalesce((c("b_adx") >= cfg.adx_threshold) & F.when(supply, c("b_dmn") > c("b_dmp")).otherwise(c("b_dmp") > c("b_dmn")), F.lit(False))
    hits = pairs.filter(ok).groupBy("symbol", "n").agg(F.min(F.struct("b_idx", "b_close", "b_atr")).alias("_b"))
    out = at.join(hits, ["symbol", "n"])
    move = F.when(supply, c("close") - c("_b.b_close")).otherwise(c("_b.b_close") - c("close")) / F.greatest("close", F.lit(1e-9))
    return out.withColumns({
        "block_type": F.when(supply, "supply").otherwise("demand"), "break_idx": c("_b.b_idx"), "brk_close": c("_b.b_close"),
        "brk_atr": c("_b.b_atr"), "base": F.greatest(move, F.lit(0.0))}).drop("_b")


def confirm_blocks(rows: DataFrame, cand: DataFrame, piv: DataFrame, cfg: BlockConfig) -> DataFrame:
    """Keep candidates whose retest within ``window`` bars of the break holds; add strength."""
    supply = c("block_type") == "supply"
    cand = cand.filter((c("confirm_idx") < c("break_idx")) & c("zone_low").isNotNull() & c("zone_high").isNotNull())
    if cfg.max_age:
        cand = cand.filter(c("break_idx") - c("idx") <= cfg.max_age)
    crowded = (c("next_confirm") < c("break_idx")) & (c("next_idx") - c("idx") <= cfg.min_gap)
    cand = cand.filter(~F.coalesce(crowded, F.lit(False)))
    if cfg.structure_filter:
        fits = c("trend_direction").isNull() | (c("trend_direction") == F.when(supply, "down").otherwise("up"))
        cand = cand.filter(fits)
    else:
        cand = cand.withColumns({"structure_label": F.lit(None).cast("string"), "trend_direction": F.lit(None).cast("string")})
    cand = _fair_value_gap(rows, cand, cfg) if cfg.fvg else cand.withColumn("_fvg", F.lit(1.0))
    last = rows.groupBy("symbol").agg((F.max("idx") + 1).alias("_len"))
    cand = cand.join(last, "symbol").withColumn("_end", F.least(c("break_idx") + cfg.window, c("_len")))
    if cfg.complete_window:
        cand = cand.filter(c("_end") < c("_len"))
    span = c("zone_high") - c("zone_low")
    cols = ["high", "low", "close", "volume", "avg_volume", "atr"] + (["rsi"] if cfg.rsi else []) + (["macd_hist"] if cfg.macd else [])
    pairs = bars_between(cand, rows, c("break_idx") + 1, c("_end") - 1, max(64, cfg.window), cols)
    if cfg.zone_intact:
        pierced = F.when(supply, c("b_high") > c("zone_high") + cfg.penetration * span).otherwise(c("b_low") < c("zone_low") - cfg.penetration * span)
        bad = pairs.filter(pierced).select("symbol", "n").distinct()
        pairs = pairs.join(bad, ["symbol", "n"], "left_anti")
    tip = F.when(supply, c("b_high")).otherwise(c("b_low"))
    inside = lambda x: (x >= c("zone_low")) & (x <= c("zone_high"))
    if cfg.entry_mode == "wick":
        entered = F.when(supply, (tip >= c("zone_low")) & (tip <= c("zone_high") + cfg.penetration * span)).otherwise(
            (tip <= c("zone_high")) & (tip >= c("zone_low") - cfg.penetration * span))
    else:
        entered = inside(c("b_close")) if cfg.entry_mode == "close" else inside(tip) | inside(c("b_close"))
    ok = entered & F.coalesce(c("b_volume") > c("b_avg_volume"), F.lit(True))
    if cfg.rsi:
        ok = ok & F.coalesce(F.when(supply, c("b_rsi") >= cfg.rsi[1]).otherwise(c("b_rsi") <= cfg.rsi[2]), F.lit(False))
    if cfg.macd:
        ok = ok & F.coalesce(F.when(supply, c("b_macd_hist") <= 0).otherwise(c("b_macd_hist") >= 0), F.lit(False))
    if cfg.closure_outside:
        ok = ok & F.when(supply, c("b_close") < c("zone_low")).otherwise(c("b_close") > c("zone_high"))
    ref = F.when(supply, c("zone_high")).otherwise(c("zone_low"))
    react = F.when(supply, ref - c("b_close")).otherwise(c("b_close") - ref)
    pairs = pairs.filter(ok).withColumns({"_ra": react, "_rp": react / F.greatest(ref, F.lit(1e-9))})
    enough = F.coalesce(c("_ra") >= cfg.displacement * c("b_atr"), F.lit(False)) if cfg.displacement > 0 else c("_rp") >= cfg.min_reaction
    pairs = pairs.filter(enough)
    if cfg.flow_shift:
        pairs = _flow_shift(pairs, piv, cfg)
    first = pairs.groupBy("symbol", "n").agg(F.min(F.struct("b_idx", "b_volume", "b_avg_volume", "b_atr", "_ra", "_rp")).alias("_t"))
    out = cand.join(first, ["symbol", "n"])
    vol = c("_t.b_volume") / F.greatest(F.coalesce("_t.b_avg_volume", F.lit(float("nan"))), F.lit(1e-9))
    vol = F.log1p(vol) if cfg.log_volume else vol
    reaction = c("_t._ra") / F.greatest("_t.b_atr", F.lit(1e-9)) if cfg.atr_normalize else c("_t._rp")
    age = F.pow(F.lit(0.5), (c("break_idx") - c("idx")) / cfg.halflife) if cfg.age_penalty else F.lit(1.0)
    mult = vol * F.least(reaction, F.lit(cfg.reaction_cap)) * age * c("_fvg")
    out = out.withColumns({"retest_idx": c("_t.b_idx"), "mult": mult}).drop("_t", "_fvg", "_len", "_end")
    if cfg.breaker:
        rows2 = number_bars(out.withColumnRenamed("idx", "_i"), 1, ts="_i").withColumn("supply", F.when(supply, 1.0).otherwise(0.0)).withColumns(
            {"zlo": c("zone_low"), "zhi": c("zone_high")})
        kern = K.breaker_bonus(cfg.breaker_lookback, cfg.breaker_bonus, cfg.max_multiplier, cfg.displacement if cfg.breaker_displacement else None)
        st = fold(rows2, kern, ["supply", "zlo", "zhi", "brk_close", "brk_atr", "base", "mult"], {"strength": "double"}, keep=["n"])
        out = out.join(st.select("symbol", "n", "strength"), ["symbol", "n"])
    else:
        out = out.withColumn("strength", F.greatest(F.lit(0.0), c("base") * F.least("mult", F.lit(cfg.max_multiplier))))
    return out


def _fair_value_gap(rows: DataFrame, cand: DataFrame, cfg: BlockConfig) -> DataFrame:
    """The bar before and after the break leave a gap (within tolerance); optional volume condition."""
    f = Frame.of_numbered(rows.select("symbol", "idx", "high", "low", "volume", "avg_volume"), 1, 1)
    f = f.add(_ph=f.lag(c("high")), _pl=f.lag(c("low")), _nh=f.lead(c("high")), _nl=f.lead(c("low")), _pv=f.lag(c("volume")), _nv=f.lead(c("volume")))
    near = f.core("symbol", c("idx").alias("break_idx"), "_ph", "_pl", "_nh", "_nl", "_pv", c("volume").alias("_cv"), "_nv", c("avg_volume").alias("_av"))
    slack = cfg.fvg_tolerance * F.abs(c("_ph") - c("_nl"))
    gap = F.when(c("block_type") == "supply", c("_nh") < c("_pl") + slack).otherwise(c("_nl") > c("_ph") - slack)
    if cfg.fvg_volume > 0:
        big = [c(v) > cfg.fvg_volume * c("_av") for v in ("_pv", "_cv", "_nv")]
        gap = gap & {"center": big[1], "first": big[0], "last": big[2]}.get(cfg.fvg_mode, big[0] | big[1] | big[2])
    kept = cand.join(near, ["symbol", "break_idx"]).filter(F.coalesce(gap, F.lit(False)))
    return kept.drop(*[x for x in near.columns if x.startswith("_")]).withColumn("_fvg", F.lit(cfg.fvg_bonus))


def _flow_shift(pairs: DataFrame, piv: DataFrame, cfg: BlockConfig) -> DataFrame:
    """The last pivot confirmed between the extreme and the retest bar moved the right way."""
    p = with_neighbours(piv).select("symbol", c("idx"), c("price").alias("pp"), c("kind").alias("pk"), c("confirm_idx").alias("pc"))
    seen = bars_between(pairs.select("symbol", "n", "idx", "kind", "price", "price_1", "price_2", "b_idx"), p.withColumnRenamed("idx", "idx"),
                        c("idx") + 1, c("b_idx") - 1, 64, ["pp", "pk", "pc"], prefix="p_")
    last = seen.filter(c("p_pc") < c("b_idx")).groupBy("symbol", "n", "b_idx").agg(F.max(F.struct("p_idx", "p_pp", "p_pk")).alias("_l"))
    j = pairs.join(last, ["symbol", "n", "b_idx"], "left")
    # the block's own pivot is of kind `kind`: the pivot of the same kind before it is two back, of the other kind one back
    before = F.when(c("_l.p_pk") == c("kind"), c("price_2")).otherwise(c("price_1"))
    lower = c("_l.p_pp") < before
    ok = F.when(c("block_type") == "supply", lower).otherwise(c("_l.p_pp") > before)
    return j.filter(F.when(c("_l").isNull(), F.lit(not cfg.shift_needs_extremes)).otherwise(F.coalesce(ok, F.lit(False)))).drop("_l")


def cluster_blocks(blocks: DataFrame, tolerance: float, max_gap_ms: int | None) -> DataFrame:
    """Merge blocks of one type that follow each other in price within the tolerance."""
    keyed = blocks.withColumns({"_k": F.concat_ws("|", "symbol", "block_type"), "_mid": (c("zone_low") + c("zone_high")) / 2, "start": c("start_ts")})
    rows = ordinals(keyed.withColumnRenamed("idx", "_i"), ["_k"], ["_mid", "start", "_i"]).withColumns({"zlo": c("zone_low"), "zhi": c("zone_high")})
    done = fold(rows, K.chain_clusters(tolerance, max_gap_ms), ["zlo", "zhi", "start"], {"opens": "long"}, key="_k",
                keep=["symbol", "block_type", "start", "break_idx", "retest_idx", "zone_low", "zone_high", "strength"])
    f = Frame.of_numbered(done, 0, key="_k")
    done = running(f, cluster=("sum", c("opens"))).core().withColumn("cluster", c("cluster") - 1)
    return done.groupBy("symbol", "block_type", "cluster").agg(
        F.min("start").alias("start_ts"), F.max("break_idx").alias("break_idx"), F.max("retest_idx").alias("retest_idx"),
        F.min("zone_low").alias("zone_low"), F.max("zone_high").alias("zone_high"), F.max("strength").alias("strength"), F.count(F.lit(1)).alias("n_blocks"))


def order_blocks(numbered: DataFrame, cfg: BlockConfig) -> DataFrame:
    """Bars to confirmed (and optionally merged) order blocks."""
    rows = settled(precompute(numbered, cfg))
    piv = settled(structure_labels(pivots(rows, cfg.reversal or 0.01, cfg.reversal_pct), cfg.min_consecutive))
    cand = block_candidates(rows, piv, cfg)
    blocks = confirm_blocks(rows, cand, piv, cfg).withColumn("start_ts", c("ts"))
    if cfg.cluster:
        return cluster_blocks(blocks, cfg.cluster_tolerance, cfg.cluster_gap_ms)
    return blocks.select("symbol", "block_type", "idx", "start_ts", "break_idx", "retest_idx", "zone_low", "zone_high", "strength",
                         "structure_label", "trend_direction", "confirm_idx", "next_idx")


# -- research detector ------------------------------------------------------
def swing_blocks(numbered: DataFrame, swing: int = 5, disp: float = 1.5, confirm: int = 5) -> DataFrame:
    """Swing highs and lows followed by a displacement; break and retest are found without a horizon.

    Needs ``atr`` on the bars. Not causal before ``confirm_idx``: a swing is known ``swing`` bars later.
    """
    f = Frame.of_numbered(numbered, 51, swing + confirm + 1)
    prev, nxt = f.rows(swing, 1), f.next_rows(swing)
    seg = f.w.rowsBetween(0, confirm)
    f = f.add(
        _n=F.count("close").over(f.next_rows(swing + confirm)), _p=F.count("close").over(prev),
        _top=(c("high") >= F.max("high").over(prev)) & (c("high") >= F.max("high").over(nxt)),
        _bot=(c("low") <= F.min("low").over(prev)) & (c("low") <= F.min("low").over(nxt)),
        _lo=F.min(F.struct(c("close"), c("idx"))).over(seg), _hi=F.max(F.struct(c("close"), (-c("idx")).alias("back"))).over(seg),
        trend=F.when(c("close") >= F.avg("close").over(f.rows(51)), "up").otherwise("down"))
    base = f.core().filter((c("_p") == swing) & (c("_n") == swing + confirm) & (c("atr") > 0))
    kinds = F.array(
        F.struct(F.lit("supply").alias("t"), c("_top").alias("ok"), F.least("open", "close").alias("lo"), c("high").alias("hi"), c("_lo.close").alias("d"), c("_lo.idx").alias("at")),
        F.struct(F.lit("demand").alias("t"), c("_bot").alias("ok"), c("low").alias("lo"), F.greatest("open", "close").alias("hi"), c("_hi.close").alias("d"), (-c("_hi.back")).alias("at")))
    b = base.withColumn("_k", F.explode(kinds)).filter(c("_k.ok") & (F.abs(c("_k.d") - c("close")) >= disp * c("atr")))
    b = b.select("symbol", "idx", "ts", "atr", "trend", c("_k.t").alias("block_type"), c("_k.lo").alias("zone_low"), c("_k.hi").alias("zone_high"),
                 (F.abs(c("_k.d") - c("close")) / c("atr")).alias("strength"), c("_k.at").alias("confirm_idx"))
    b = settled(b.withColumn("block_id", 2 * c("idx") + F.when(c("block_type") == "demand", 1).otherwise(0)))
    ids, demand = ["symbol", "block_id"], c("block_type") == "demand"
    close = numbered.select("symbol", "idx", "close")
    ladder = Ladder.of(close, ["close"])
    b = first_crossing(b, close, ids, c("idx"), "close", F.when(demand, c("zone_low")).otherwise(c("zone_high")), demand, "_brk", ladder=ladder)
    b = first_crossing(b, close, ids, c("idx"), "close", F.when(demand, c("zone_high")).otherwise(c("zone_low")), demand, "_ret", inclusive=True, ladder=ladder)
    last = numbered.groupBy("symbol").agg(F.max("idx").alias("_last"))
    b = b.join(last, "symbol").withColumn("end_idx", F.coalesce("_brk", "_last"))
    held = c("_ret").isNotNull() & (c("_brk").isNull() | (c("_ret") < c("_brk")))
    b = b.withColumn("retest_idx", F.when(held, c("_ret")).otherwise(c("end_idx")))
    return b.select("symbol", "block_id", "block_type", "idx", "ts", "zone_low", "zone_high", "strength", "trend", "confirm_idx", "end_idx", "retest_idx",
                    F.when(c("retest_idx") < c("end_idx"), "retested").otherwise("fresh").alias("structure"),
                    ((c("zone_high") - c("zone_low")) / c("atr")).alias("height_atr"))


# -- entries ----------------------------------------------------------------
# fixed values: which family names an entry when several fall on one bar and side
FAMILY_ORDER = ["sweep", "ob_retest", "ob_touch", "fvg", "avsl_bounce", "break_retest"]
_OUT = ["symbol", "entry_idx", "side", "family", "zone_low", "zone_high", "block_id"]


def _side(demand: Column) -> Column:
    return F.when(demand, "long").otherwise("short")


def zone_ladder(rows: DataFrame) -> Ladder:
    """What the searches for touches, sweeps and invalidations climb."""
    return Ladder.of(rows, ["low", "high", "close", "atr"])


def _with_invalidation(blocks: DataFrame, rows: DataFrame, ladder: Ladder | None = None) -> DataFrame:
    """``_dead``: first close beyond the zone after confirmation; ``_until``: last bar before it."""
    demand = c("block_type") == "demand"
    edge = F.when(demand, c("zone_low")).otherwise(c("zone_high"))
    b = first_crossing(blocks, rows, ["symbol", "block_id"], c("confirm_idx"), "close", edge, demand, "_dead", ladder=ladder)
    last = rows.groupBy("symbol").agg(F.max("idx").alias("_last"))
    return settled(b.join(last, "symbol").withColumn("_until", F.coalesce(c("_dead") - 1, "_last")))


def zone_touches(alive: DataFrame, rows: DataFrame, tol_atr: float = 0.0, ladder: Ladder | None = None) -> DataFrame:
    """First and second touch of each zone before its invalidation (``touch`` 1 and 2)."""
    def touching(lo: Column, hi: Column) -> Column:
        tol = tol_atr * F.coalesce(hi["atr"], F.lit(0.0))
        return F.when(c("block_type") == "demand", (hi["low"] >= c("zone_low") - tol) & (lo["low"] <= c("zone_high"))).otherwise(
            (hi["high"] >= c("zone_low")) & (lo["high"] <= c("zone_high") + tol))

    hits = (ladder or zone_ladder(rows)).hits(alive, ["symbol", "block_id"], c("confirm_idx"), touching, ["block_type", "zone_low", "zone_high"], 2, c("_until"))
    return alive.join(hits.select("symbol", "block_id", c("nth").alias("touch"), c("bar").alias("entry_idx")), ["symbol", "block_id"]).select(*alive.columns, "touch", "entry_idx")


def touch_entries(alive: DataFrame, rows: DataFrame, tol_atr: float = 0.0, ladder: Ladder | None = None) -> DataFrame:
    t = zone_touches(alive, rows, tol_atr, ladder)
    return t.withColumns({"side": _side(c("block_type") == "demand"), "family": F.when(c("touch") == 1, "ob_touch").otherwise("ob_retest")}).select(*_OUT)


def sweep_entries(blocks: DataFrame, rows: DataFrame, wick_atr: float = 0.5, ladder: Ladder | None = None) -> DataFrame:
    """First bar that pierces the zone by a wick and closes back; invalidation does not end the search."""
    def swept(lo: Column, hi: Column) -> Column:
        return F.when(c("block_type") == "demand", (lo["low"] < c("zone_low") - wick_atr * lo["atr"]) & (hi["close"] > c("zone_low"))).otherwise(
            (hi["high"] > c("zone_high") + wick_atr * lo["atr"]) & (lo["close"] < c("zone_high")))

    own = ["symbol", "block_id", "block_type", "zone_low", "zone_high"]
    hits = (ladder or zone_ladder(rows)).hits(blocks, ["symbol", "block_id"], c("confirm_idx"), swept, own[2:])
    first = blocks.select(*own).join(hits.select("symbol", "block_id", c("bar").alias("entry_idx")), ["symbol", "block_id"])
    return first.withColumns({"side": _side(c("block_type") == "demand"), "family": F.lit("sweep")}).select(*_OUT)


def gap_entries(rows: DataFrame, min_gap_atr: float = 0.2, wait: int = 100) -> DataFrame:
    """Three-bar gaps and the first bar within ``wait`` that enters them."""
    f = Frame.of_numbered(rows.select("symbol", "idx", "high", "low", "atr"), 2)
    h2, l2 = f.lag(c("high"), 2), f.lag(c("low"), 2)
    f = f.add(_h2=h2, _l2=l2)
    bull, bear = c("low") - c("_h2") >= min_gap_atr * c("atr"), c("_l2") - c("high") >= min_gap_atr * c("atr")
    g = f.core().filter((c("atr") > 0) & (bull | bear)).withColumn("is_long", bull)
    g = g.select("symbol", "idx", "is_long", F.when(c("is_long"), c("_h2")).otherwise(c("high")).alias("zone_low"), F.when(c("is_long"), c("low")).otherwise(c("_l2")).alias("zone_high"))
    pairs = bars_between(g, rows, c("idx") + 1, c("idx") + wait, 128, ["high", "low"])
    hit = F.when(c("is_long"), c("b_low") <= c("zone_high")).otherwise(c("b_high") >= c("zone_low"))
    first = pairs.filter(hit).groupBy("symbol", "idx", "is_long", "zone_low", "zone_high").agg(F.min("b_idx").alias("entry_idx"))
    return first.withColumns({"side": _side(c("is_long")), "family": F.lit("fvg"), "block_id": F.lit(-1).cast("long")}).select(*_OUT)


def bounce_entries(rows: DataFrame, tol_atr: float = 0.3) -> DataFrame:
    """Bars that touch a support line and close up, or a resistance line and close down."""
    tol = tol_atr * c("atr")
    sides = F.array(
        F.when((F.abs(c("low") - c("avsl")) <= tol) & (c("close") > c("open")), F.struct(F.lit("long").alias("side"), c("avsl").alias("line"))),
        F.when((F.abs(c("high") - c("avsr")) <= tol) & (c("close") < c("open")), F.struct(F.lit("short").alias("side"), c("avsr").alias("line"))))
    hit = rows.filter(c("atr") > 0).withColumn("_s", F.explode(sides)).filter(c("_s").isNotNull())
    return hit.select("symbol", c("idx").alias("entry_idx"), c("_s.side").alias("side"), F.lit("avsl_bounce").alias("family"),
                      (c("_s.line") - tol).alias("zone_low"), (c("_s.line") + tol).alias("zone_high"), F.lit(-1).cast("long").alias("block_id"))


def break_retest_entries(alive: DataFrame, rows: DataFrame, wait: int = 200) -> DataFrame:
    """After the invalidating close, the first return to the zone within ``wait`` bars, in the other direction."""
    demand = c("block_type") == "demand"
    broken = alive.filter(c("_dead").isNotNull())
    pairs = bars_between(broken, rows, c("_dead") + 1, c("_dead") + wait, 256, ["high", "low"])
    hit = F.when(demand, c("b_high") >= c("zone_low")).otherwise(c("b_low") <= c("zone_high"))
    first = pairs.filter(hit).groupBy("symbol", "block_id", "block_type", "zone_low", "zone_high").agg(F.min("b_idx").alias("entry_idx"))
    return first.withColumns({"side": _side(~demand), "family": F.lit("break_retest")}).select(*_OUT)


def dedupe_entries(entries: DataFrame) -> DataFrame:
    """One entry per bar and side, by family order; ``overlap`` marks bars where families met."""
    prio = F.array_position(F.array(*[F.lit(x) for x in FAMILY_ORDER]), c("family"))
    best = F.min_by(F.struct("family", "zone_low", "zone_high", "block_id"), F.struct(prio, "block_id", "zone_low", "zone_high"))
    g = entries.groupBy("symbol", "entry_idx", "side").agg(best.alias("_b"), (F.size(F.collect_set("family")) > 1).alias("overlap"))
    return g.select("symbol", "entry_idx", "side", "_b.family", "_b.zone_low", "_b.zone_high", "_b.block_id", "overlap")


def collect_entries(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """All entry families over bars with ``atr``, ``avsl`` and ``avsr``."""
    ladder = zone_ladder(rows)
    alive = _with_invalidation(blocks, rows, ladder)
    parts = [touch_entries(alive, rows, ladder=ladder), sweep_entries(alive, rows, ladder=ladder), gap_entries(rows), bounce_entries(rows), break_retest_entries(alive, rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return dedupe_entries(out)


# -- zones as features ------------------------------------------------------
def paint_zone(blocks: DataFrame, rows: DataFrame, side: str, life: int = 2000) -> DataFrame:
    """Level of the first block (in list order) still painting each bar after its break."""
    demand = side == "long"
    b = blocks.filter(c("block_type") == ("demand" if demand else "supply"))
    level = c("zone_low") if demand else c("zone_high")
    pairs = bars_between(b.withColumn("_level", level), rows, c("end_idx"), c("end_idx") + life - 1, 1024, [])
    return pairs.groupBy("symbol", c("b_idx").alias("idx")).agg(F.min_by("_level", "block_id").alias("zone"))


def block_distances(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Distance in ATR to the nearest supply, the nearest demand and the strongest live block; 999 without any."""
    zones = blocks.select("symbol", c("block_type").alias("kind"), c("idx").alias("start"), c("end_idx").alias("end"), c("zone_low").alias("low"), c("zone_high").alias("high"),
                          c("block_id").alias("id"), c("strength").alias("rank"), F.struct("block_id").alias("carry"))
    seen = live_zones(rows.select("symbol", "idx", c("close").alias("price"), c("atr").alias("unit")), zones)
    near = lambda kind: F.min(F.when(c("kind") == kind, c("near.distance")))
    g = seen.groupBy("symbol", "idx").agg(near("supply").alias("near_supply"), near("demand").alias("near_demand"),
                                          F.max_by("best.distance", F.struct("best.rank", "best.back")).alias("strongest"), F.max(c("inside").cast("double")).alias("in_zone"))
    return rows.select("symbol", "idx").join(g, ["symbol", "idx"], "left").fillna(999.0, ["near_supply", "near_demand", "strongest"]).fillna(0.0, ["in_zone"])


def block_features(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """State of the nearest live block per type from its confirmation on, counts, and a flag for 50 bars after a break."""
    b = blocks.withColumn("kind", c("block_type"))
    zones = b.select("symbol", "kind", c("confirm_idx").alias("start"), c("end_idx").alias("end"), c("zone_low").alias("low"), c("zone_high").alias("high"), c("block_id").alias("id"),
                     c("strength").alias("rank"), F.struct("strength", (c("zone_high") - c("zone_low")).alias("height"), "confirm_idx").alias("carry"))
    unit = F.when(c("atr") > 0, c("atr")).otherwise(1.0)
    near = live_zones(rows.select("symbol", "idx", c("close").alias("price"), unit.alias("unit")), zones).select(
        "symbol", "idx", "kind", c("near.distance").alias("dist"), c("near.carry.strength").alias("strength"), (c("near.carry.height") / c("unit")).alias("height"),
        (c("idx") - c("near.carry.confirm_idx")).cast("double").alias("age"), c("inside").cast("double").alias("in_zone"))
    spans = {"live": (c("confirm_idx"), c("end_idx")), "broken": (c("end_idx") + 1, c("end_idx") + 50),
             "retested": (F.when(c("retest_idx") < c("end_idx"), F.greatest("retest_idx", "confirm_idx")), c("end_idx"))}
    over = covering(rows.select("symbol", "idx").withColumn("kind", F.explode(F.array(F.lit("supply"), F.lit("demand")))), b, ["symbol", "kind"], spans)
    over = over.select("symbol", "idx", "kind", (F.least(c("live"), F.lit(10)) / 10).alias("count"), (c("broken") > 0).cast("double").alias("broken"), (c("retested") > 0).cast("double").alias("retested"))
    both = over.join(near, ["symbol", "idx", "kind"], "left")
    names = ["dist", "in_zone", "strength", "height", "age", "retested", "count", "broken"]
    wide = both.groupBy("symbol", "idx").agg(*[F.max(F.when(c("kind") == k, c(n))).alias(f"{n}_{k}") for k in ("supply", "demand") for n in names])
    return wide.fillna(0.0, [f"{n}_{k}" for k in ("supply", "demand") for n in names if n != "dist"])


def map_to_base(blocks: DataFrame, htf: DataFrame, base: DataFrame, htf_ms: int, base_ms: int, fields: list[str]) -> DataFrame:
    """Bar ordinals of a longer timeframe to those of the base: the first base bar at or after the close."""
    from ..operators.asof import asof

    edges = htf.select("symbol", "idx", (c("ts") + htf_ms - base_ms).alias("_at"))
    at = asof(edges, base.select("symbol", "ts", "idx"), "_at", "ts", ["idx"], 1024 * base_ms, prefix="base_", forward=True)
    out = blocks
    for name in fields:
        m = at.select("symbol", c("idx").alias(name), c("base_idx").alias(f"base_{name}"))
        out = out.join(m, ["symbol", name], "left")
    return out


def peaks(numbered: DataFrame, x: str = "high", prominence: float = 0.01, distance: int = 5, plateau: int = 0, wlen: int | None = None,
          valley: bool = False) -> DataFrame:
    """Local maxima (minima for ``valley``) kept by height, then by prominence. Looks ahead.

    A plateau counts once, at its middle. Higher peaks suppress lower ones closer than ``distance``:
    a peak is decided once every higher neighbour is, so rounds repeat until all are.
    """
    from ..operators.running import running

    sign = -1.0 if valley else 1.0
    b = numbered.select("symbol", "idx", (sign * c(x)).alias("x"))
    f = Frame.of_numbered(b, 2, 2)
    f = f.add(_new=F.when(F.coalesce(c("x") != f.lag(c("x")), F.lit(True)), c("idx")), _pv=f.lag(c("x")))
    runs = running(f, 1, run=("last", c("_new"))).core("symbol", "idx", "x", "run", "_pv")
    g = runs.groupBy("symbol", "run").agg(F.max("idx").alias("z"), F.max("x").alias("x"), F.max_by("_pv", F.when(c("idx") == c("run"), c("idx"))).alias("left"))
    nxt = b.select("symbol", (c("idx") - 1).alias("z"), c("x").alias("right"))
    g = g.join(nxt, ["symbol", "z"]).filter((c("x") > c("left")) & (c("x") > c("right")) & (c("z") - c("run") + 1 >= plateau))
    cur = settled(g.select("symbol", F.floor((c("run") + c("z")) / 2).alias("idx"), "x"))
    kept = None
    while distance > 1:
        near = Frame.of_numbered(cur, distance, distance)
        span = near.w.rangeBetween(-(distance - 1), distance - 1)
        top = F.max(F.struct(c("x"), (-c("idx")).alias("k"))).over(span)
        now = settled(near.add(_top=top).core("symbol", "idx", "x", (-c("_top.k") == c("idx")).alias("best")))
        best = now.filter("best").drop("best")
        kept = best if kept is None else settled(kept.unionByName(best))
        shadow = best.select("symbol", F.explode(F.sequence(c("idx") - (distance - 1), c("idx") + (distance - 1))).alias("idx")).distinct()
        cur = settled(now.filter(~c("best")).drop("best").join(shadow, ["symbol", "idx"], "left_anti"))
        if cur.isEmpty():
            break
    found = kept if kept is not None else cur
    if prominence <= 0:
        return found.select("symbol", "idx", (sign * c("x")).alias("price"))
    # prominent on a side: the price falls far enough before it rises above the peak
    flipped = b.select("symbol", (-c("idx")).alias("idx"), "x")
    out = found
    for name, bars, at in (("r", b, c("idx")), ("l", _shifted(flipped, numbered), c("_m"))):
        ev = out if name == "r" else _mirror(out, numbered)
        ladder = Ladder.of(bars, ["x"])
        ev = first_crossing(ev, bars, ["symbol", "idx"], at, "x", c("x") - prominence, F.lit(True), f"{name}d", inclusive=True, ladder=ladder)
        ev = settled(first_crossing(ev, bars, ["symbol", "idx"], at, "x", c("x"), F.lit(False), f"{name}u", ladder=ladder))
        ok = c(f"{name}d").isNotNull() & (c(f"{name}u").isNull() | (c(f"{name}d") < c(f"{name}u")))
        if wlen:
            ok = ok & (c(f"{name}d") - at <= wlen // 2)
        out = ev.filter(ok).select("symbol", "idx", "x")
    return out.select("symbol", "idx", (sign * c("x")).alias("price"))


def _last_idx(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("symbol").agg(F.max("idx").alias("_l"))


def _shifted(flipped: DataFrame, numbered: DataFrame) -> DataFrame:
    """Bars counted from the end of each symbol."""
    return flipped.join(_last_idx(numbered), "symbol").select("symbol", (c("idx") + c("_l")).alias("idx"), "x")


def _mirror(events: DataFrame, numbered: DataFrame) -> DataFrame:
    return events.join(_last_idx(numbered), "symbol").withColumn("_m", c("_l") - c("idx")).drop("_l")


def first_zone_at(points: DataFrame, zones: DataFrame, prices: list[str], cells: int = 4096) -> DataFrame:
    """Smallest ``block_id`` among zones ended by the bar that contain one of its prices.

    The price axis of a symbol is cut into cells. A zone that covers a whole cell counts for every price
    in it, so an as-of join on time finds the smallest id so far; only the two cells at a zone's edges
    compare prices.
    """
    from ..operators.asof import asof

    span = zones.groupBy("symbol").agg(F.min("zone_low").alias("_a"), F.max("zone_high").alias("_b")).withColumn(
        "_w", F.greatest((c("_b") - c("_a")) / cells, F.lit(1e-12)))
    cell = lambda v: F.floor((v - c("_a")) / c("_w"))
    z = zones.join(span, "symbol").withColumns({"_c0": cell(c("zone_low")), "_c1": cell(c("zone_high"))})
    key = lambda: F.concat_ws("|", "symbol", c("_cell").cast("string")).alias("_key")
    inner = z.filter(c("_c1") - c("_c0") >= 2).withColumn("_cell", F.explode(F.sequence(c("_c0") + 1, c("_c1") - 1)))
    by = Window.partitionBy("_key").orderBy("end_idx", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    steps = inner.groupBy(key(), "end_idx").agg(F.min("block_id").alias("block_id")).withColumn("best", F.min("block_id").over(by))
    p = points.join(span, "symbol").withColumn("_px", F.explode(F.array(*[c(x) for x in prices]))).withColumn("_cell", cell(c("_px")))
    p = p.select("symbol", "idx", "_px", "_cell", key())
    full = asof(p, steps, "idx", "end_idx", ["best"], 1024, key="_key").select("symbol", "idx", c("best").alias("block_id"))
    edge = z.withColumn("_cell", F.explode(F.array_distinct(F.array("_c0", "_c1")))).select("symbol", "_cell", "zone_low", "zone_high", "end_idx", "block_id")
    part = p.join(edge, ["symbol", "_cell"]).filter((c("_px") >= c("zone_low")) & (c("_px") <= c("zone_high")) & (c("end_idx") <= c("idx")))
    both = full.filter(c("block_id").isNotNull()).unionByName(part.select("symbol", "idx", "block_id"))
    return both.groupBy("symbol", "idx").agg(F.min("block_id").alias("block_id"))


def nearest_zones(points: DataFrame, zones: DataFrame, known: str, price: str = "close") -> DataFrame:
    """Distance from the price to the nearest zone below and above among those known by the bar; zero inside one.

    Zones never expire, so a bar must not meet each of them. In order of becoming known they form
    blocks of 1, 2, 4, … zones; the zones known at a bar are at most one block per size. In a block the
    answer is an as-of join on price: the last upper edge below, the first lower edge above, and from
    the ranks of both whether a zone holds the price.
    """
    z = settled(ordinals(zones.select("symbol", known, "zone_low", "zone_high"), ["symbol"], [known, "zone_low", "zone_high"], "zn"))
    levels = ((z.agg(F.max("zn")).first()[0] or 0) + 1).bit_length()
    at = z.groupBy("symbol", known).agg((F.max("zn") + 1).alias("n"))
    p = asof_sorted(points.select("symbol", "idx", c(price).alias("px")), at, "idx", known, ["n"], ["symbol"]).filter(c("n").isNotNull())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    key = F.concat_ws("|", "symbol", c("lv").cast("string"), c("blk").cast("string"))
    at_level = lambda x: F.expr(f"shiftright({x}, lv)")
    zc = z.withColumn("lv", level).withColumn("blk", at_level("zn")).withColumn("_key", key)
    pc = p.withColumn("lv", level).filter(at_level("n") % 2 == 1).withColumn("blk", at_level("n") - 1).withColumn("_key", key).select("_key", "symbol", "idx", "px")
    # a zone without height lies below a price that equals it: as a lower edge it counts from just under its price
    edge = F.when(c("zone_low") == c("zone_high"), c("zone_low") - F.abs("zone_low") * 2.0**-52).otherwise(c("zone_low"))
    lows = ordinals(zc.select("_key", "zone_low", edge.alias("edge"), "zn"), ["_key"], ["edge", "zn"], "k")
    highs = ordinals(zc.select("_key", "zone_high", "zn"), ["_key"], ["zone_high", "zn"], "k")
    first_low = lows.groupBy("_key", "edge").agg(F.min("k").alias("n_low"), F.min("zone_low").alias("lo"))
    last_high = highs.groupBy("_key", "zone_high").agg((F.max("k") + 1).alias("n_high"))
    size = zc.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"))
    j = asof_sorted(pc, first_low, "px", "edge", ["lo", "n_low"], ["_key"], forward=True)
    j = asof_sorted(j, last_high.withColumn("hi", c("zone_high")), "px", "zone_high", ["hi", "n_high"], ["_key"]).join(size, "_key")
    # zones that start under the price minus those that end at or under it
    j = j.withColumn("_in", F.coalesce("n_low", "_size") - F.coalesce("n_high", F.lit(0)) > 0)
    g = j.groupBy("symbol", "idx").agg(F.min(c("px") - c("hi")).alias("_b"), F.min(c("lo") - c("px")).alias("_a"), F.max("_in").alias("_i"))
    g = g.select("symbol", "idx", F.when(c("_i"), 0.0).otherwise(c("_b")).alias("below"), F.when(c("_i"), 0.0).otherwise(c("_a")).alias("above"))
    return points.select("symbol", "idx").join(g, ["symbol", "idx"], "left")
