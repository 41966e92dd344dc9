"""Ranking, deciles, books and reshaping across symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ratio
from ..operators.frames import Frame, ordinals

c = F.col


def exact_rank(df: DataFrame, by: str, tie: list[str], out: str = "rank") -> DataFrame:
    """0-based global rank; equal values are ordered by the tie columns."""
    return ordinals(df, [], [by, *tie], out)


def rank_normalize(df: DataFrame, by: str, tie: list[str], out: str = "score01") -> DataFrame:
    """Ranks scaled to [0, 1]; ties broken by ``tie``; a single row gets 0."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = exact_rank(df, by, tie, "_rk").crossJoin(F.broadcast(n))
    return r.withColumn(out, F.when(c("_n") > 1, c("_rk") / (c("_n") - 1)).otherwise(0.0)).drop("_rk", "_n")


def deciles(df: DataFrame, score: str, y: str, k: int = 10) -> DataFrame:
    """Count and mean of ``y`` per score bucket; edges are exact quantiles, right-open."""
    edges = df.agg(F.percentile(score, F.array(*[F.lit(i / k) for i in range(1, k)])).alias("_e"))
    b = df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("_e", lambda e: e <= c(score))))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"))


def top_share(df: DataFrame, score: str, tie: list[str], y: str, shares: list[float]) -> DataFrame:
    """Mean of ``y`` over the best share of rows by score, for several shares; at least one row each."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = exact_rank(df.withColumn("_neg", -c(score)), "_neg", tie, "_rk").crossJoin(F.broadcast(n))
    ks = F.explode(F.array(*[F.lit(q) for q in shares])).alias("q")
    return ranked.select("_rk", "_n", y, ks).filter(c("_rk") < F.greatest(F.floor(c("_n") * c("q")), F.lit(1))).groupBy("q").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"))


def ev_threshold(df: DataFrame, p: str, r: str, grid: int = 19) -> DataFrame:
    """The score threshold with the best mean outcome among quantiles; zero means take nothing special."""
    qs = [i / (grid + 1) for i in range(grid + 1)]
    cand = df.agg(F.percentile(p, F.array(*[F.lit(q) for q in qs])).alias("_q"))
    # count and sum per interval between thresholds, then cumulate from the top: no row is repeated
    cut = df.filter(c(r).isNotNull()).crossJoin(F.broadcast(cand)).withColumn("_i", F.size(F.filter("_q", lambda e: e <= c(p))))
    part = cut.groupBy("_i").agg(F.count(r).alias("n"), F.sum(r).alias("s"))
    thr = cand.select(F.posexplode("_q").alias("pos", "threshold"))
    above = thr.join(F.broadcast(part), c("_i") > c("pos"), "left").groupBy("pos", "threshold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    ev = above.filter("n > 0").select("threshold", "n", (c("s") / c("n")).alias("ev"), "pos")
    best = F.max_by(F.struct("threshold", "ev", "n"), F.struct(F.round("ev", 12), -c("pos")))
    return ev.filter("ev > 0").agg(best.alias("_b")).select(c("_b.threshold").alias("threshold"), c("_b.ev").alias("ev"), c("_b.n").alias("n"))


def top_bottom_book(panel: DataFrame, k: int, every: int, day: str = "day", inst: str = "symbol", signal: str = "signal") -> DataFrame:
    """Equal-weight long bottom / short top books, refreshed every ``every`` days and held between.

    Weights exist on refresh days only; each day looks up its refresh day by arithmetic.
    """
    days = panel.filter(c(signal).isNotNull())
    refresh = days.filter(c(day) % every == 0)
    by = Window.partitionBy(day)
    ranked = refresh.withColumns({
        "_up": F.row_number().over(by.orderBy(c(signal).desc(), inst)), "_dn": F.row_number().over(by.orderBy(c(signal), inst)),
        "_n": F.count(F.lit(1)).over(by)})
    w = F.when(c("_up") <= k, -1.0 / k).when(c("_dn") <= k, 1.0 / k).otherwise(0.0)
    book = ranked.filter(c("_n") >= 2 * k).select(c(day).alias("_rd"), inst, w.alias("w")).filter("w != 0")
    return panel.withColumn("_rd", (F.floor(c(day) / every) * every).cast("long")).join(book, ["_rd", inst], "left").withColumn(
        "w", F.coalesce("w", F.lit(0.0))).drop("_rd")


def fraction_weights(panel: DataFrame, top: float = 0.2, bottom: float = 0.2, min_assets: int = 5, day: str = "day",
                     inst: str = "symbol", z: str = "z") -> DataFrame:
    """Long the lowest scores, short the highest, equal weights inside each side."""
    by = Window.partitionBy(day)
    r = panel.filter(c(z).isNotNull()).withColumns({
        "_r": F.row_number().over(by.orderBy(z, inst)), "_n": F.count(F.lit(1)).over(by)})
    nl, ns = F.greatest(F.floor(c("_n") * bottom), F.lit(1)), F.greatest(F.floor(c("_n") * top), F.lit(1))
    w = F.when(c("_n") < min_assets, 0.0).when(c("_r") <= nl, 1.0 / nl).when(c("_r") > c("_n") - ns, -1.0 / ns).otherwise(0.0)
    return r.withColumn("w", w).drop("_r", "_n")


def terciles(panel: DataFrame, by: list[str], x: str, out: str = "tercile") -> DataFrame:
    cut = panel.groupBy(*by).agg(F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q"))
    return panel.join(cut, by).withColumn(out, F.when(c(x) <= c("_q")[0], 1).when(c(x) <= c("_q")[1], 2).otherwise(3)).drop("_q")


def turnover(book: DataFrame, day: str = "day", inst: str = "symbol", w: str = "w", step: int = 1) -> DataFrame:
    """Sum of absolute weight changes against the previous day, entries and exits included."""
    held = book.filter(c(w) != 0).select(day, inst, w)
    moved = held.select((c(day) + step).alias(day), inst, (-c(w)).alias(w))
    days = book.select(day).distinct()
    change = held.unionByName(moved).groupBy(day, inst).agg(F.sum(w).alias("_d"))
    return days.join(change.groupBy(day).agg(F.sum(F.abs("_d")).alias("turnover")), day, "left").fillna(0.0, ["turnover"])


def set_similarity(book: DataFrame, day: str = "day", inst: str = "symbol", step: int = 1) -> DataFrame:
    """Jaccard similarity of consecutive member sets, by counting shared members."""
    m = book.select(day, inst).distinct()
    n = m.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    prev = m.select((c(day) + step).alias(day), inst)
    both = m.join(prev, [day, inst]).groupBy(day).agg(F.count(F.lit(1)).alias("k"))
    before = n.select((c(day) + step).alias(day), c("n").alias("m"))
    return n.join(before, day).join(both, day, "left").select(day, (F.coalesce("k", F.lit(0)) / (c("n") + c("m") - F.coalesce("k", F.lit(0)))).alias("jaccard"))


def pick_rules(train: DataFrame, min_trades: int = 30, fallback: str = "zone:1.0") -> DataFrame:
    """Best rule per regime and side if it has enough trades and a positive mean, else the fallback."""
    st = train.filter(c("r_net").isNotNull()).groupBy("regime", "side", "rule").agg(F.count(F.lit(1)).alias("n"), F.avg("r_net").alias("ev"))
    best = st.groupBy("regime", "side").agg(F.max_by(F.struct("rule", "n", "ev"), F.struct("ev", "rule")).alias("_b"))
    return best.select("regime", "side", F.when((c("_b.n") >= min_trades) & (c("_b.ev") > 0), c("_b.rule")).otherwise(fallback).alias("rule"))


def apply_rules(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(table, ["regime", "side", "rule"], "left_semi")


def policy_values(rows: DataFrame, key: list[str], score: str, r: str = "r_net", fixed: str | None = None) -> DataFrame:
    """Mean outcome of the oracle choice, a random choice, the top score and a fixed rule per candidate."""
    ok = rows.filter(c(r).isNotNull())
    g = ok.groupBy(*key).agg(
        F.max(r).alias("best"), F.avg(r).alias("any"), F.max_by(r, F.struct(c(score), "rule")).alias("picked"),
        F.first(F.when(c("rule") == fixed, c(r)), ignorenulls=True).alias("fixed") if fixed else F.lit(None).cast("double").alias("fixed"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("best").alias("oracle_ev"), F.avg("any").alias("random_ev"),
                 F.avg("picked").alias("picked_ev"), F.avg("fixed").alias("fixed_ev"))


def score_flips(rows: DataFrame, key: list[str], score: str, noise: Column) -> DataFrame:
    """Share of candidates whose top rule changes when the score is shaken."""
    g = rows.groupBy(*key).agg(F.max_by("rule", F.struct(c(score), "rule")).alias("a"), F.max_by("rule", F.struct(c(score) + noise, "rule")).alias("b"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg((c("a") != c("b")).cast("double")).alias("flip_share"))


def piecewise(x: Column, table: list[tuple[float, float]]) -> Column:
    """Linear interpolation with flat ends through a short table of points."""
    pts = sorted(table)
    out = F.lit(pts[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(pts, pts[1:]))):
        out = F.when(x < x1, y0 + (y1 - y0) / (x1 - x0) * (x - x0)).otherwise(out)
    return F.when(x <= pts[0][0], pts[0][1]).otherwise(out)




def hysteresis(f: Frame, out: str, enter_long: Column, exit_long: Column, enter_short: Column, exit_short: Column) -> Frame:
    """Position from entry and exit conditions that do not depend on the entry: last event wins, exits before entries."""
    from ..operators.running import running

    event = F.when(enter_long, 1).when(enter_short, -1).when(exit_long | exit_short, 0)
    f = running(f, 1, **{out: ("last", event)})
    return f.add(**{out: F.coalesce(out, F.lit(0))})
