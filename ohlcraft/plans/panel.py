"""The outcome panel: candidates crossed with executions, stops and targets, and what is learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import c, mean, percent_rank, std
from ..operators.frames import Frame
from ..sources.store import settled
from . import outcomes as O

DAY_MS = 86_400_000
# fixed values: the stop rules, targets and executions of the panel
STOP_RULES = ["atr:14", "atr:27", "atr:54", "zone:0.5", "zone:1.0", "anchor:avsl:0.5", "anchor:avsr:0.5", "anchor:hilo:0.5", "anchor:st:0.5",
              "anchor:bb:0.5", "anchor:bb:1.0"]
TARGETS = [2.0, 3.0]
EXECUTIONS = ["market", "limit:edge", "limit:mid"]


# -- splits -----------------------------------------------------------------
def purged_split(rows: DataFrame, n: Column, hold: int, train: float = 0.6, val: float = 0.2, idx: str = "idx") -> DataFrame:
    """Label rows train, val or test with a gap of ``hold`` bars around each cut; NULL inside a gap."""
    a, b = F.floor(n * train), F.floor(n * (train + val) + 1e-9)
    i = c(idx)
    label = F.when(i + hold < a, "train").when((i >= a + hold) & (i < b - hold), "val").when((i >= b + hold) & (i < n), "test")
    return rows.withColumn("split", label)


def gap_split(rows: DataFrame, n: Column, gap: int, train: float = 0.7, val: float = 0.15, idx: str = "idx") -> DataFrame:
    """Consecutive segments with ``gap`` bars between them; ``pos`` counts from the segment's start.

    Later segments also get the ``gap`` rows before them as context, marked by a negative ``pos``.
    """
    usable = n - 2 * gap
    nt, nv = F.floor(usable * train), F.floor(usable * val)
    bounds = F.array(F.struct(F.lit("train").alias("split"), F.lit(0).cast("long").alias("a"), nt.alias("z"), F.lit(0).alias("ctx")),
                     F.struct(F.lit("val").alias("split"), (nt + gap).alias("a"), (nt + gap + nv).alias("z"), F.lit(gap).alias("ctx")),
                     F.struct(F.lit("test").alias("split"), (nt + nv + 2 * gap).alias("a"), n.alias("z"), F.lit(gap).alias("ctx")))
    out = rows.withColumn("_s", F.explode(bounds)).filter((c(idx) >= c("_s.a") - c("_s.ctx")) & (c(idx) < c("_s.z")))
    return out.withColumns({"split": c("_s.split"), "pos": c(idx) - c("_s.a")}).drop("_s")


def walk_forward(rows: DataFrame, n_folds: int = 8, fold_days: int = 56, embargo_days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows repeated per fold with ``part`` train or test; the embargo before a fold belongs to neither.

    The folds are the last ``n_folds`` whole windows of the data; there are at most that many.
    """
    size = fold_days * DAY_MS
    ends = rows.agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    w = F.floor((c("_t1") - c("_t0")) / size)
    folds = ends.withColumn("fold", F.explode(F.sequence(F.greatest(w - n_folds + 1, F.lit(0)), w))).select(
        "fold", (c("_t0") + c("fold") * size).alias("_a"), (c("_t0") + (c("fold") + 1) * size).alias("_z"))
    j = rows.crossJoin(F.broadcast(folds))
    part = F.when((c(ts) >= c("_a")) & (c(ts) < c("_z")), "test").when(c(ts) < c("_a") - embargo_days * DAY_MS, "train")
    return j.withColumn("part", part).filter(c("part").isNotNull()).drop("_a", "_z")


def nested_folds(rows: DataFrame, n_folds: int = 8, fold_days: int = 56, embargo_days: int = 7, inner_share: float = 0.2, inner_gap_days: int = 7, ts: str = "ts") -> DataFrame:
    """Bounds of outer and inner folds, one row per fold: test from ``a`` to ``z``, train before ``until``, of which what lies
    before ``cut`` trains and what lies ``inner_gap_days`` behind it validates the choice of parameters.

    ``cut`` is the time of the row at ``1 - inner_share`` of the fold's training rows. These are the earliest rows of all, so
    one ranking of the table serves every fold.
    """
    from ..operators.frames import ordinals

    size = fold_days * DAY_MS
    ranked = ordinals(rows.select(c(ts).alias("_ts")), [], ["_ts"], "_k")
    ends = ranked.agg(F.min("_ts").alias("_t0"), F.max("_ts").alias("_t1"))
    w = F.floor((c("_t1") - c("_t0")) / size)
    folds = settled(ends.filter("_t0 is not null").withColumn("fold", F.explode(F.sequence(F.greatest(w - n_folds + 1, F.lit(0)), w))).select(
        "fold", (c("_t0") + c("fold") * size).alias("a"), (c("_t0") + (c("fold") + 1) * size).alias("z")).withColumn("until", c("a") - embargo_days * DAY_MS))
    train = ranked.join(F.broadcast(folds), c("_ts") < c("until")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))  # n_folds rows
    at = train.select("fold", F.floor(c("n") * (1 - inner_share) + 1e-9).cast("long").alias("_k"))
    cut = at.join(ranked, "_k").select("fold", c("_ts").alias("cut"))
    return folds.join(cut, "fold", "left").withColumn("inner_from", c("cut") + inner_gap_days * DAY_MS)


def with_folds(rows: DataFrame, folds: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``folds``: the (fold, part) memberships of each row, part being test, train, inner_train or inner_val.

    Rows are not copied per fold; the bounds, one row per fold, are packed into one array that every row reads.
    """
    bounds = folds.agg(F.collect_list(F.struct("fold", "a", "z", "until", "cut", "inner_from")).alias("_f"))
    t = c(ts)
    part = lambda f: F.array_compact(F.array(
        F.when((t >= f["a"]) & (t < f["z"]), F.struct(f["fold"].alias("fold"), F.lit("test").alias("part"))),
        F.when(t < f["until"], F.struct(f["fold"].alias("fold"), F.lit("train").alias("part"))),
        F.when(t < f["until"], F.when(t < f["cut"], F.struct(f["fold"].alias("fold"), F.lit("inner_train").alias("part"))).when(
            t >= f["inner_from"], F.struct(f["fold"].alias("fold"), F.lit("inner_val").alias("part"))))))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("folds", F.flatten(F.transform("_f", part))).drop("_f")  # one row of bounds


def rolling_windows(rows: DataFrame, train: int, test: int, step: int, n: Column, idx: str = "idx") -> DataFrame:
    """Rolling train/test windows by ordinal; each row finds its windows by arithmetic."""
    lo = F.greatest(F.ceil((c(idx) - train - test + 1) / step), F.lit(0))
    hi = F.floor(c(idx) / step)
    w = rows.withColumn("window", F.explode(F.when(hi >= lo, F.sequence(lo, hi)))).filter(c("window") * step + train + test <= n)
    return w.withColumn("part", F.when(c(idx) < c("window") * step + train, "train").otherwise("test"))


# -- features ---------------------------------------------------------------
def trend_state(f: Frame, n: int = 50, slope_bars: int = 10) -> Frame:
    """Distance to the mean and its slope in ATR, and the side of the mean."""
    f = f.add(_avg=mean(f, "close", n))
    ok = c("_avg").isNotNull() & (c("atr") > 0)
    f = f.add(z=F.when(ok, (c("close") - c("_avg")) / c("atr")))
    return f.add(slope=F.when(ok, (c("_avg") - f.lag(c("_avg"), slope_bars)) / c("atr")),
                 trend=F.when(ok, F.when(c("close") >= c("_avg"), 1).otherwise(-1)).otherwise(0))


def regime_of(z: Column) -> Column:
    return F.when(z.isNull(), "unknown").when(z > 0.5, "up").when(z < -0.5, "down").otherwise("range")


def impulse_features(f: Frame, bars: int = 6, win: int = 50) -> Frame:
    """Short-timeframe move over ``bars`` bars and the z-score of the volume over what exists of ``win`` bars."""
    w = f.rows(win)
    sd = F.stddev_pop("volume").over(w)
    return f.add(move=c("close") - f.lag(c("close"), bars), vol_z=F.when(sd > 0, (c("volume") - F.avg("volume").over(w)) / sd).otherwise(0.0))


def percentile_features(f: Frame, win: int = 500) -> Frame:
    """Percent rank of the ATR share and of the band width in a trailing window."""
    f = f.add(_ap=c("atr") / c("close"), _bw=4 * std(f, "close", 20, 0) / mean(f, "close", 20))
    return f.add(vol_pct=percent_rank(f, "_ap", win), bbw_pct=percent_rank(f, "_bw", win))


# fixed values: the features of a candidate at its decision bar
ANCHORS = ["avsl", "avsr", "hilo_l", "hilo_s", "st", "bb_l", "bb_u"]
NUMERIC = ["atr_pct", "zone_height_atr", "zone_dist_atr", "z50", "slope50", "vol_pct", "bbw_pct", *[f"d_{a}" for a in ANCHORS],
           *[f"h{k}_{x}" for k in (1, 2) for x in ("trend", "slope", "below", "above")], "ltf_impulse", "ltf_vol_z"]
CATEGORICAL = ["side", "family", "regime_dir", "ob_trend", "ob_structure", "overlap"]


def higher_states(bars: DataFrame, n: int = 50, slope_bars: int = 10) -> DataFrame:
    """Trend, slope and distances to the nearest zones of each bar of a longer timeframe, known at ``known_ts``.

    ``bars`` are numbered and carry ``known_ts``. A zone counts from the bar that confirms it, once that bar is closed.
    """
    from ..functions.volatility import research_atr
    from .structure import nearest_zones, swing_blocks

    rows = settled(trend_state(research_atr(Frame.of_numbered(bars, max(16, n + slope_bars)), "atr"), n, slope_bars).core())
    near = nearest_zones(rows, swing_blocks(rows.drop("z", "slope", "trend")), "confirm_idx")
    state = F.struct(c("trend").cast("double").alias("trend"), F.coalesce("slope", F.lit(0.0)).alias("slope"), "below", "above")
    return rows.join(near, ["symbol", "idx"]).select("symbol", "known_ts", state.alias("state"))


def lower_states(bars: DataFrame, bar_ms: int, impulse_bars: int = 6, volume_bars: int = 50) -> DataFrame:
    """Move over a few bars of a shorter timeframe and the z-score of its volume; neither before ``impulse_bars`` bars are known."""
    f = impulse_features(Frame.of_numbered(bars, max(impulse_bars, volume_bars)), impulse_bars, volume_bars)
    there = c("idx") >= impulse_bars
    return f.core("symbol", (c("ts") + bar_ms).alias("known_ts"), F.struct(F.when(there, c("move")).alias("move"), F.when(there, c("vol_z")).alias("vol_z")).alias("state"))


def carried(base: DataFrame, states: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Add the last state of every timeframe known at each base bar: all timeframes pass once, in one ordered scan."""
    from ..operators.scan import scan

    rows = base.select("symbol", c(ts).alias("_t"), F.lit(len(states)).alias("_side"), F.struct(*base.columns).alias("_base"))
    for i, (name, s) in enumerate(states.items()):
        rows = rows.unionByName(s.select("symbol", c("known_ts").alias("_t"), F.lit(i).alias("_side"), c("state").alias(name)), allowMissingColumns=True)
    done = scan(rows, ["symbol"], ["_t", "_side"], last={f"_{n}": c(n) for n in states})
    return done.filter(c("_base").isNotNull()).select("_base.*", *[c(f"_{n}").alias(n) for n in states])


def feature_rows(cands: DataFrame, bars: DataFrame, blocks: DataFrame) -> DataFrame:
    """The 24 numbers and 6 categories of every candidate, read at its decision bar.

    ``bars``: ``close, atr, z, slope, vol_pct, bbw_pct``, an ``a_`` column per anchor, and the states ``h1, h2, ltf`` from
    :func:`carried`. ``cands``: ``symbol, idx, side, family, zone_low, zone_high, block_id, overlap``.
    """
    b = blocks.select("symbol", "block_id", c("trend").alias("_trend"), c("structure").alias("_structure"))
    j = cands.join(bars, ["symbol", "idx"]).join(b, ["symbol", "block_id"], "left")
    long = c("side") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    unit = F.when(c("atr") > 0, c("atr"))
    base = F.when(c("atr") > 0, c("atr")).otherwise(1.0)
    num = {"atr_pct": F.when(c("close") > 0, c("atr") / c("close")), "zone_height_atr": (c("zone_high") - c("zone_low")) / unit,
           "zone_dist_atr": (c("close") - F.when(long, c("zone_low")).otherwise(c("zone_high"))) * sign / unit,
           "z50": c("z"), "slope50": c("slope"), "vol_pct": c("vol_pct"), "bbw_pct": c("bbw_pct")}
    num |= {f"d_{a}": (c("close") - c(f"a_{a}")) * sign / unit for a in ANCHORS}
    for k in (1, 2):
        num |= {f"h{k}_trend": F.coalesce(f"h{k}.trend", F.lit(0.0)), f"h{k}_slope": F.coalesce(f"h{k}.slope", F.lit(0.0)),
                f"h{k}_below": c(f"h{k}.below") / base, f"h{k}_above": c(f"h{k}.above") / base}
    num |= {"ltf_impulse": c("ltf.move") / unit, "ltf_vol_z": c("ltf.vol_z")}
    cat = {"side": c("side"), "family": c("family"), "regime_dir": regime_of(c("z")), "ob_trend": F.coalesce("_trend", F.lit("none")),
           "ob_structure": F.coalesce("_structure", F.lit("none")), "overlap": c("overlap")}
    return j.select("symbol", "idx", *[num[x].alias(x) for x in NUMERIC], *[cat[x].alias(x) for x in CATEGORICAL])


def normalise(numbered: DataFrame, cols: list[str], volume: str = "volume", head: int = 500) -> DataFrame:
    """Prices over the median of the first ``head`` closes; volume over its own median, then log1p."""
    ref = numbered.filter(c("idx") < head).groupBy("symbol").agg(F.percentile("close", 0.5).alias("_p"), F.percentile(volume, 0.5).alias("_v"))
    j = numbered.join(ref, "symbol")
    out = {x: F.when(c("_p") > 0, c(x) / F.nullif("_p", F.lit(0.0))).otherwise(c(x)) for x in cols}
    out[volume] = F.when(c("_v") > 0, F.log1p(c(volume) / F.nullif("_v", F.lit(0.0)))).otherwise(c(volume))
    return j.withColumns(out).drop("_p", "_v")


def sequences(f: Frame, cols: list[str], n: int) -> Frame:
    """Sliding windows of feature rows, oldest first."""
    return f.add(window=f.full(F.collect_list(F.struct(*cols)), c(cols[0]), n))


# -- panel ------------------------------------------------------------------
def outcome_panel(cands: DataFrame, bars: DataFrame, rules: list[str], targets: list[float], hold: int = 48, commission: float = 0.001,
                  slippage: float = 0.0005, wait: int = 5, min_risk_atr: float = 0.5) -> DataFrame:
    """Every candidate under every execution, stop rule and target.

    ``cands`` carries the decision bar: ``symbol, idx, is_long, close, atr, zone, zone_low, zone_high`` and anchors.
    """
    nxt = bars.select("symbol", (c("idx") - 1).alias("idx"), c("open").alias("_no"))
    base = cands.join(nxt, ["symbol", "idx"])
    level = {"market": None, "limit:edge": F.when(c("is_long"), c("zone_low")).otherwise(c("zone_high")), "limit:mid": (c("zone_low") + c("zone_high")) / 2}
    filled = base.withColumns({"execution": F.lit("market"), "fill_idx": c("idx") + 1, "fill": c("_no") * (1 + O.sign() * slippage)})
    grid = base.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("lv")) for k, v in level.items() if v is not None])))
    grid = grid.withColumns({"execution": c("_x.k"), "fill": c("_x.lv")}).drop("_x")
    limits = O.limit_fill(grid, bars, ["symbol", "idx", "is_long", "execution"], c("fill"), wait)
    ex = filled.unionByName(limits.select(*filled.columns)).drop("_no")
    rows = O.stop_levels(ex, rules, targets, 0.0).withColumn("risk_unit", F.abs(c("fill") - c("stop")))
    valid = c("fill_idx").isNotNull() & c("stop").isNotNull() & (O.sign() * (c("fill") - c("stop")) >= 0) & (c("risk_unit") >= min_risk_atr * c("atr"))
    rows = rows.withColumns({"filled": c("fill_idx").isNotNull(), "_ok": valid, "target": c("fill") + O.sign() * c("target_r") * c("risk_unit")})
    ids = ["symbol", "idx", "is_long", "execution", "rule", "target_r"]
    good = O.barrier_outcome(rows.filter("_ok").drop("risk_unit"), bars, ids, hold, commission, slippage)
    good = O.excursions(good, bars, ids, hold)
    bad = rows.filter(~F.coalesce("_ok", F.lit(False)))
    return good.unionByName(bad, allowMissingColumns=True).drop("_ok")


def candidate_key() -> Column:
    return F.concat_ws("_", "idx", F.when(c("is_long"), "long").otherwise("short"))


def cost_in_r(rate: float = 0.0025) -> Column:
    return rate * c("fill") / c("risk_unit")


def relevance(y: Column) -> Column:
    """Grades 0 to 12 from outcomes in R, half-even rounding."""
    return F.greatest(F.lit(0), F.least(F.lit(12), F.bround((y + 2) * 2).cast("int")))


def replay(panel: DataFrame, bars: DataFrame, score: str = "score", hold: int = 48) -> DataFrame:
    """Best-scored row per candidate, its outcome, and the trades one position at a time would take."""
    from ..operators.frames import number_bars
    from .portfolio import state_machine

    top = panel.groupBy("symbol", "idx", "is_long").agg(F.max_by(F.struct("rule", "stop", "target", "atr"), F.struct(c(score), "rule")).alias("_t"))
    nxt = bars.select("symbol", (c("idx") - 1).alias("idx"), c("open").alias("fill"))
    ev = top.join(nxt, ["symbol", "idx"]).select("symbol", "idx", "is_long", "fill", (c("idx") + 1).alias("fill_idx"), "_t.rule", "_t.stop", "_t.target", "_t.atr")
    out = O.pessimistic(O.barrier_outcome(ev, bars, ["symbol", "idx", "is_long"], hold - 1, 0.001, 0.0005)).filter(c("r_net").isNotNull())
    sig = number_bars(out.withColumnRenamed("idx", "decision").withColumnsRenamed({"exit_idx": "exit"}).withColumns({"side": O.sign(), "_o": -O.sign()}), 1, ts="decision", ties=("_o",))
    taken = state_machine(sig).filter("status = 'taken'")
    return out.join(taken.select("symbol", c("decision").alias("idx"), (c("side") > 0).alias("is_long")), ["symbol", "idx", "is_long"], "left_semi")


# -- strategy labels --------------------------------------------------------
def strategy_labels(decisions: DataFrame, bars: DataFrame, max_hold: int = 20, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """Entry (1), exit (2) and ignore (-100) per bar with the outcome on the entry bar, one position at a time.

    ``decisions`` has ``symbol, idx, is_long, tp, sl``: bars where a trade would be opened if flat.
    """
    from ..operators.frames import number_bars
    from .portfolio import state_machine

    nxt = bars.select("symbol", (c("idx") - 1).alias("idx"), c("open").alias("_o"))
    ev = decisions.join(nxt, ["symbol", "idx"]).withColumns({"fill": c("_o") * (1 + O.sign() * slippage), "stop": c("sl"), "target": c("tp"), "fill_idx": c("idx") + 1})
    seen = O.touches(ev, bars, ["symbol", "idx"], c("fill_idx"), c("fill_idx") + max_hold - 1, max_hold)
    timed = c("hit").isNull() & (c("last_idx") == c("fill_idx") + max_hold - 1)
    seen = seen.withColumn("exit", F.coalesce("hit_idx", F.when(timed, c("last_idx")), F.lit(-1)).cast("long"))
    raw = F.when(c("hit") == "tp", c("tp")).when(c("hit") == "sl", c("sl") * (1 - O.sign() * slippage)).when(timed, c("last_close") * (1 - O.sign() * slippage))
    risk = F.abs(c("fill") - c("sl"))
    seen = seen.withColumn("r", F.when(risk > 0, (O.sign() * (raw - c("fill")) - commission * (c("fill") + raw)) / F.nullif(risk, F.lit(0.0))).otherwise(0.0))
    sig = number_bars(seen.withColumnRenamed("idx", "decision").withColumn("side", O.sign()), 1, ts="decision")
    taken = state_machine(sig).filter("status = 'taken'").select("symbol", c("decision").alias("idx"), c("exit").alias("_x"))
    entered = seen.join(taken, ["symbol", "idx"]).select("symbol", "idx", F.lit(1).alias("action"), F.when(c("_x") >= 0, c("r")).alias("outcome"), "_x")
    exits = entered.filter("_x >= 0").select("symbol", c("_x").alias("idx"), F.lit(2).alias("_exit"))
    out = bars.select("symbol", "idx").join(entered.drop("_x"), ["symbol", "idx"], "left").join(exits, ["symbol", "idx"], "left")
    return out.select("symbol", "idx", F.coalesce("_exit", "action", F.lit(-100)).alias("action"), "outcome")


def reward_ok(min_rr: float = 1 / 3) -> Column:
    """Stop and target on the right sides of the close, reward at least ``min_rr`` times the risk."""
    good, bad = O.sign() * (c("tp") - c("close")), O.sign() * (c("close") - c("sl"))
    return (good > 0) & (bad > 0) & (good / F.nullif(bad, F.lit(0.0)) >= min_rr)
