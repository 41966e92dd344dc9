"""Portfolio streams, robust statistics and gates.

A stream is ``(book, idx, r)``: one row per bar of a book on a dense grid. Books replace
symbols as the key, so cumulative work uses the same chunked frames as indicators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ratio
from ..operators.fold import fold
from ..operators.frames import Frame
from ..operators.running import running
from ..operators.selection import wide_quantiles
from ..sources.store import settled
from .spectra import correlations

c = F.col
BOOK = "book"


# -- sizing -----------------------------------------------------------------
def vol_target_size(f: Frame, win: int = 100, target: float = 0.20, low: float = 0.25, high: float = 2.0,
                    per_year: float = 6 * 365, out: str = "size") -> Frame:
    """Target volatility over realised volatility of the prior bars (population std), clipped."""
    f = f.add(_lr=F.log(c("close") / F.nullif(f.lag(c("close")), F.lit(0.0))))
    vol = F.stddev_pop("_lr").over(f.rows(win, 1)) * per_year**0.5
    f = f.add(_vol=vol)
    return f.add(**{out: F.when(c("_vol") > 0, F.greatest(F.lit(low), F.least(F.lit(high), target / c("_vol")))).otherwise(1.0)})


def regime_size(pct: Column) -> Column:
    return F.when(pct > 90, 0.25).when(pct > 80, 0.5).otherwise(1.0)


# -- streams ----------------------------------------------------------------
def spread_trades(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Each trade adds ``size*net/(hold+1)`` to every bar from ``e0`` to ``e1``.

    Only the two ends are emitted; the bars between follow from a running sum.
    """
    hold = F.greatest(c("e1") - c("e0"), F.lit(1))
    w = c("size") * c("net") / (hold + 1)
    ends = F.array(F.struct(c("e0").alias("idx"), w.alias("d"), F.lit(1).alias("n")),
                   F.struct((c("e1") + 1).alias("idx"), (-w).alias("d"), F.lit(-1).alias("n")))
    return trades.select(*keys, F.explode(ends).alias("_e")).groupBy(*keys, c("_e.idx").alias("idx")).agg(
        F.sum("_e.d").alias("d"), F.sum("_e.n").alias("n"))


def grid(spark, n: Column | int, book: str, books: DataFrame) -> DataFrame:
    """Dense bars ``0..n-1`` for each book, built piece by piece."""
    piece = 4096
    base = books.withColumn("_n", n if isinstance(n, Column) else F.lit(n))
    pieces = base.withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor((c("_n") - 1) / piece)))).repartition(book, "_p")
    return pieces.select(*books.columns, F.explode(F.sequence(c("_p") * piece, F.least((c("_p") + 1) * piece, c("_n")) - 1)).alias("idx"))


def accrual(trades: DataFrame, books: DataFrame, book: str = BOOK) -> DataFrame:
    """Stream ``(book, idx, r, n_open)`` of the sized trades; ``books`` has ``(book, n)``."""
    steps = spread_trades(trades, [book])
    dense = grid(trades.sparkSession, c("n"), book, books).join(steps, [book, "idx"], "left").withColumns(
        {"d": F.coalesce("d", F.lit(0.0)), "n_open": F.coalesce(steps["n"], F.lit(0))})
    f = running(Frame.of_numbered(dense.select(book, "idx", "d", "n_open"), 0, key=book), r=("sum", c("d")), open=("sum", c("n_open")))
    return f.core(book, "idx", F.when(F.abs("r") < 1e-15, 0.0).otherwise(c("r")).alias("r"), c("open").alias("n_open"))


def accrual_direct(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The same by one row per trade and bar: for sparse matrices of asset by bar."""
    hold = F.greatest(c("e1") - c("e0"), F.lit(1))
    return trades.select(*keys, F.explode(F.sequence("e0", "e1")).alias("idx"), (c("size") * c("net") / (hold + 1)).alias("w")).groupBy(
        *keys, "idx").agg(F.sum("w").alias("r"))


def rollup(stream: DataFrame, every: int, book: str = BOOK) -> DataFrame:
    return stream.groupBy(book, F.floor(c("idx") / every).alias("day")).agg(F.sum("r").alias("r"), F.max_by("r", "idx").alias("last_r"))


# -- statistics -------------------------------------------------------------
def lag_sums(stream: DataFrame, lags: int, first: int = 1, book: str = BOOK, x: str = "r", size: int = 2048) -> DataFrame:
    """Pairs of values ``k`` bars apart, for every ``k`` from ``first`` to ``lags``: their number, sums, squares and products.

    A chunk and the ``lags`` bars after it hold every pair that starts in the chunk, so each
    chunk yields five sums per lag and nothing per pair is shuffled.
    """
    f = Frame.of_numbered(stream.select(book, "idx", x), 0, lags, size, book)
    chunks = f.df.groupBy(book, "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", c(x).alias("v")))).alias("_a"))
    arr = F.transform("_a", lambda s: s["v"])
    own = F.size(F.filter("_a", lambda s: F.floor(s["idx"] / size) == c("chunk")))
    per = chunks.select(book, arr.alias("v"), own.alias("m"), F.explode(F.sequence(F.lit(first), F.lit(lags))).alias("k"))
    n = F.greatest(F.least("m", F.size("v") - c("k")), F.lit(0))
    per = per.withColumn("n", n).withColumns({"xs": F.slice("v", F.lit(1), c("n")), "ys": F.slice("v", c("k") + 1, c("n"))})

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    sums = per.filter("n > 0").select(
        book, "k", "n", total(c("xs")).alias("sx"), total(c("ys")).alias("sy"),
        total(F.zip_with("xs", "ys", lambda a, b: a * b)).alias("sxy"),
        total(F.transform("xs", lambda a: a * a)).alias("sxx"), total(F.transform("ys", lambda a: a * a)).alias("syy"))
    return sums.groupBy(book, "k").agg(*[F.sum(q).alias(q) for q in ("n", "sx", "sy", "sxy", "sxx", "syy")])


def lag_correlations(stream: DataFrame, lags: int, book: str = BOOK, x: str = "r", size: int = 2048) -> DataFrame:
    """Correlation of the stream with itself ``k`` bars later for every ``k`` up to ``lags``."""
    agg = lag_sums(stream, lags, 1, book, x, size)
    vx, vy = c("n") * c("sxx") - c("sx") * c("sx"), c("n") * c("syy") - c("sy") * c("sy")
    cov = c("n") * c("sxy") - c("sx") * c("sy")
    return agg.select(book, "k", "n", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"))


def nw_sharpe(stream: DataFrame, lags: int = 500, per_year: float = 6 * 365, book: str = BOOK, min_obs: int = 30,
              clamp: tuple[float, float] | None = None) -> DataFrame:
    """Sharpe ratio over ``sqrt(max(1e-6, 1 + 2*sum of lag correlations))``; NULL under 30 bars.

    ``clamp`` bounds the variance factor, as the short-lag variants do.
    """
    base = stream.groupBy(book).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    rho = lag_correlations(stream, lags, book).join(base.select(book, c("n").alias("_n")), book)
    rho = rho.filter(c("k") <= c("_n") - 10).groupBy(book).agg(F.sum("rho").alias("srho"))
    factor = 1 + 2 * F.coalesce("srho", F.lit(0.0))
    factor = F.greatest(F.lit(1e-6), factor) if clamp is None else F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), factor))
    value = c("mean") / F.nullif("sd", F.lit(0.0)) * per_year**0.5 / F.sqrt(factor)
    return base.join(rho, book, "left").select(book, "n", F.when((c("n") >= min_obs) & (c("sd") > 0), value).alias("sharpe_nw"))


def drawdown(stream: DataFrame, risk: float = 0.01, book: str = BOOK) -> DataFrame:
    """Largest fall of the compounded curve from its peak."""
    f = Frame.of_numbered(stream.select(book, "idx", "r"), 0, key=book)
    f = running(f, _s=("sum", F.log1p(risk * c("r")))).settle()
    f = running(f, _p=("max", c("_s")))
    return f.core().groupBy(book).agg(F.max(1 - F.exp(c("_s") - c("_p"))).alias("dd"))


def drawdown_r(trades: DataFrame, book: str = BOOK, x: str = "r") -> DataFrame:
    """Largest fall in R of the additive curve; the first trade is its own peak."""
    f = Frame.of_numbered(trades.select(book, "idx", x), 0, key=book)
    f = running(f, _s=("sum", c(x))).settle()
    f = running(f, _p=("max", c("_s")))
    return f.core().groupBy(book).agg(F.max(c("_p") - c("_s")).alias("max_dd_r"))


def trade_stats(trades: DataFrame, by: list[str], r: str = "net") -> DataFrame:
    """Count, mean, t statistic, profit factor, win rate."""
    wins, losses = F.sum(F.when(c(r) > 0, c(r)).otherwise(0.0)), F.sum(F.when(c(r) < 0, -c(r)).otherwise(0.0))
    a = trades.filter(c(r).isNotNull()).groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("ev"), F.stddev_samp(r).alias("_sd"), wins.alias("_w"), losses.alias("_l"),
        F.avg((c(r) > 0).cast("double")).alias("win_rate"))
    t = F.when(c("_sd") > 0, c("ev") / c("_sd") * F.sqrt("n")).otherwise(0.0)
    return a.select(*by, "n", "ev", t.alias("t_stat"), F.when(c("_l") > 0, c("_w") / c("_l")).alias("profit_factor"), "win_rate",
                    F.when(c("_sd") > 0, c("ev") / c("_sd")).otherwise(0.0).alias("sharpe_per_trade"))


def bucketed_sharpe(trades: DataFrame, by: list[str], r: str = "net", ts: str = "ts", days: int = 7) -> DataFrame:
    """Sharpe of the sums per ``days``-bucket from the first trade on, empty buckets counting as zero."""
    span = days * 86_400_000
    first = trades.groupBy(*by).agg(F.min(ts).alias("_t0"))
    sums = trades.join(first, by).groupBy(*by, F.floor((c(ts) - c("_t0")) / span).alias("_b")).agg(F.sum(r).alias("_s"))
    # zero buckets add nothing to the sums, only to the count
    a = sums.groupBy(*by).agg((F.max("_b") + 1).alias("k"), F.sum("_s").alias("s"), F.sum(c("_s") * c("_s")).alias("ss"))
    mean = c("s") / c("k")
    var = (c("ss") - c("k") * mean * mean) / F.nullif(c("k") - 1, F.lit(0))
    return a.select(*by, F.when((c("k") >= 2) & (var > 0), mean / F.sqrt(F.when(var > 0, var)) * (365.25 / days) ** 0.5).otherwise(0.0).alias("sharpe_ann"))


def hashed(*parts: Column | int) -> Column:
    """A reproducible pseudo-random integer below 2^31-1 from small integers."""
    x = F.lit(0).cast("long")
    for p in parts:
        x = ((x + (p if isinstance(p, Column) else F.lit(p)).cast("long") + 1) * 48271) % 2147483647
        x = (x * 69621 + 12345) % 2147483647
    return x


def block_bootstrap(stream: DataFrame, block: int = 500, reps: int = 1000, seed: int = 11, book: str = BOOK) -> DataFrame:
    """95 % interval of the mean from circular blocks with hashed starts.

    Block sums come from prefix sums, so a replicate costs its number of blocks, not its number of bars.
    """
    f = running(Frame.of_numbered(stream.select(book, "idx", "r"), 0, key=book), _s=("sum", c("r")))
    prefix = settled(f.core(book, (c("idx") + 1).alias("at"), c("_s").alias("s")))
    size = prefix.groupBy(book).agg(F.max("at").alias("n"), F.max_by("s", "at").alias("tot")).filter(c("n") >= block)
    plan = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(book, "rep")
    plan = plan.withColumn("j", F.explode(F.sequence(F.lit(0), (F.ceil(c("n") / block) - 1).cast("int"))))
    plan = plan.withColumns({"a": (hashed(F.lit(seed), c("rep"), c("j")) % c("n")).cast("long"),
                             "len": F.least(F.lit(block), c("n") - c("j") * block)})
    plan = plan.withColumn("b", c("a") + c("len"))
    plan = plan.withColumns({"b1": F.when(c("b") > c("n"), c("b") - c("n")).otherwise(c("b")), "wrap": F.when(c("b") > c("n"), c("tot")).otherwise(0.0)})
    lo, hi = prefix.select(book, c("at").alias("a"), c("s").alias("sa")), prefix.select(book, c("at").alias("b1"), c("s").alias("sb"))
    sums = plan.join(lo, [book, "a"], "left").join(hi, [book, "b1"], "left")
    total = F.coalesce("sb", F.lit(0.0)) + c("wrap") - F.coalesce("sa", F.lit(0.0))
    means = sums.groupBy(book, "rep", "n").agg((F.sum(total) / F.max("n")).alias("m"))
    return means.groupBy(book).agg(F.percentile("m", 0.025).alias("ci_lo"), F.percentile("m", 0.975).alias("ci_hi"))


def paired_bootstrap(pairs: DataFrame, reps: int = 2000, seed: int = 7, book: str = BOOK) -> DataFrame:
    """Mean of ``a-b`` with a resampled interval. ``pairs`` is numbered per book.

    A resample of n rows is a count per row; drawing it per chunk keeps the work where the rows are:
    each row joins the draws that hit it.
    """
    d = pairs.filter(c("a").isNotNull() & c("b").isNotNull()).select(book, "idx", (c("a") - c("b")).alias("d"))
    n = d.groupBy(book).agg(F.count("d").alias("n"), F.avg("d").alias("diff"))
    draws = d.join(n.select(book, "n"), book).select(book, "n", "idx", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.withColumn("pick", (hashed(F.lit(seed), c("rep"), c("idx")) % c("n")).cast("long"))
    hit = draws.groupBy(book, "pick", "rep").agg(F.count(F.lit(1)).alias("k"))
    means = hit.join(d.select(book, c("idx").alias("pick"), "d"), [book, "pick"]).groupBy(book, "rep").agg(
        (F.sum(c("k") * c("d")) / F.sum("k")).alias("m"))
    out = means.groupBy(book).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"),
                                  F.avg((c("m") <= 0).cast("double")).alias("p_le0"))
    return n.join(out, book)


def concurrency_stats(stream: DataFrame, book: str = BOOK) -> DataFrame:
    shares = wide_quantiles(stream, [book], "n_open", {"conc_p50": 0.5, "conc_p95": 0.95})
    most = stream.groupBy(book).agg(F.max("n_open").cast("double").alias("conc_max"), F.avg((c("n_open") >= 5).cast("double")).alias("pct_ge5"))
    return shares.join(most, book)


def enb(panel: DataFrame, by: str = "idx", asset: str = "symbol", x: str = "r", min_rows: int = 100) -> DataFrame:
    """Effective number of bets on active bars: assets² over the sum of squared correlations."""
    totals = panel.groupBy(by).agg(F.sum(x).alias("_t")).filter("_t != 0")
    active = panel.join(totals.select(by), by, "left_semi")
    rho = correlations(active, by, asset, x).filter(c("rho").isNotNull())
    varying = rho.filter("a = b").agg(F.count(F.lit(1)).alias("p"))
    both = rho.agg(F.sum(c("rho") * c("rho") * F.when(c("a") == c("b"), 1).otherwise(2)).alias("ss")).crossJoin(varying).crossJoin(totals.agg(F.count(F.lit(1)).alias("n_active")))
    return both.select("n_active", F.when((c("p") >= 2) & (c("n_active") >= min_rows), c("p") * c("p") / c("ss")).alias("enb"))


def ortho_ev(trades: DataFrame, by: list[str], factor: str = "f", r: str = "net") -> DataFrame:
    """Mean of the returns after removing a factor, with its t statistic."""
    t = trades.filter(c(r).isNotNull() & c(factor).isNotNull())
    fit = t.groupBy(*by).agg((F.covar_samp(r, factor) / F.nullif(F.var_pop(factor), F.lit(0.0))).alias("beta"), F.count(r).alias("n"))
    res = t.join(fit, by).withColumn("_e", c(r) - c("beta") * c(factor))
    a = res.groupBy(*by, "n").agg(F.avg("_e").alias("ev_orth"), F.stddev_pop("_e").alias("_sd"))
    return a.select(*by, "n", "ev_orth", (c("ev_orth") / F.nullif("_sd", F.lit(0.0)) * F.sqrt("n")).alias("t_orth"))


def leg_breakdown(trades: DataFrame, by: list[str], r: str = "net", top: int = 20) -> DataFrame:
    """Per group: count, mean, hold, mean without the best ``top`` trades and their share.

    The best trades are found per salt first, so one large group never meets in one task unreduced.
    """
    salt = F.pmod(F.hash(*[c(x) for x in trades.columns]), F.lit(64))
    cols = [*by, r]
    local = trades.select(*cols, salt.alias("_s")).withColumn(
        "_k", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(c(r).desc()))).filter(c("_k") <= top)
    best = local.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(c(r).desc()))).filter(c("_k") <= top).groupBy(*by).agg(
        F.sum(r).alias("_top"), F.count(r).alias("_nt"))
    a = trades.groupBy(*by).agg(F.count(r).alias("n"), F.sum(r).alias("_sum"), F.avg(c("e1") - c("e0")).alias("avg_hold"))
    j = a.join(best, by)
    return j.select(*by, "n", (c("_sum") / c("n")).alias("ev"), "avg_hold",
                    F.when(c("n") > top, (c("_sum") - c("_top")) / F.nullif(c("n") - c("_nt"), F.lit(0))).alias("ex_top_ev"),
                    (c("_top") / F.nullif("_sum", F.lit(0.0))).alias("top_share"))


def drawdown_episodes(stream: DataFrame, k: int = 5, book: str = BOOK) -> DataFrame:
    """The ``k`` deepest drawdowns of each book: runs of bars under the last peak."""
    f = Frame.of_numbered(stream.select(book, "idx", "r"), 0, key=book)
    f = running(f, _s=("sum", c("r"))).settle()
    f = running(f, _p=("max", c("_s")))
    # every bar under water belongs to the last bar that stood on the peak
    f = running(f.settle(), _at=("last", F.when(c("_s") >= c("_p"), c("idx"))))
    runs = f.core().filter(c("_s") < c("_p")).groupBy(book, c("_at").alias("peak_idx")).agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.max(c("_p") - c("_s")).alias("depth"))
    # the k deepest of a book are among the k deepest of its parts, so one book is many tasks
    part = F.row_number().over(Window.partitionBy(book, F.pmod(F.xxhash64("peak_idx"), F.lit(64))).orderBy(c("depth").desc(), "start_idx"))
    rank = F.row_number().over(Window.partitionBy(book).orderBy(c("depth").desc(), "start_idx"))
    return runs.withColumn("_part", part).filter(c("_part") <= k).drop("_part").withColumn("rank", rank).filter(c("rank") <= k)


def overlaps(a: DataFrame, b: DataFrame, book: str = BOOK) -> DataFrame:
    """Episodes of ``a`` that share a bar with an episode of ``b`` of the same book; both are short report tables."""
    cond = c(f"a.{book}").eqNullSafe(c(f"b.{book}")) & (c("a.start_idx") <= c("b.end_idx")) & (c("b.start_idx") <= c("a.end_idx"))
    return a.alias("a").join(b.alias("b"), cond, "left_semi")


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """One boolean per gate and the verdict. ``limits`` maps a metric to ('>=' or '<=', bound)."""
    out = metrics
    for name, (op, bound) in limits.items():
        ok = c(name) >= bound if op == ">=" else c(name) <= bound
        out = out.withColumn(f"gate_{name}", F.coalesce(ok, F.lit(False)))
    flags = [c(f"gate_{n}") for n in limits]
    verdict = flags[0]
    for g in flags[1:]:
        verdict = verdict & g
    return out.withColumn("verdict", F.when(verdict, "PASS").otherwise("FAIL"))


# fixed values: gate limits of the first battery, and those added by the second
GATES_V1 = {"sharpe_nw": (">=", 1.0), "dd": ("<=", 0.25), "ev": (">=", 0.1), "pos_assets": (">=", 7), "ci_lo": (">=", 1e-12)}
GATES_V2 = {"enb": (">=", 2.0), "conc_p95": ("<=", 6.0)}


def battery_verdict(metrics: DataFrame, v1: dict = GATES_V1, v2: dict = GATES_V2) -> DataFrame:
    """PASS when both batteries hold, FAIL-CORR when only the first does."""
    one, both = gates(metrics, v1), gates(metrics, {**v1, **v2})
    ok1, ok2 = (c("verdict") == "PASS").alias("v1"), (c("verdict") == "PASS").alias("v2")
    keys = metrics.columns[:1]
    j = one.select(*keys, ok1).join(both.select(*keys, ok2), keys)
    return metrics.join(j, keys).withColumn("verdict", F.when(c("v2"), "PASS").when(c("v1"), "FAIL-CORR").otherwise("FAIL"))


# -- admission --------------------------------------------------------------
def _slots(cap: int, replace_worst: bool):
    """Fixed places with the exit, score and number of the trade in each; a place is free once its exit is reached."""
    free = np.array([[-1e300], [0.0], [-1.0]])

    def run(a, state):
        exits, scores, numbers = held = np.asarray(state, float).reshape(3, cap).copy() if state else np.repeat(free, cap, axis=1)
        entry, leave, score, number = (np.asarray(a[k], float) for k in ("entry", "exit", "score", "idx"))
        taken, out = np.zeros(len(entry), bool), np.full(len(entry), np.nan)
        for i in range(len(entry)):
            place = int(np.argmin(exits))
            if exits[place] > entry[i]:  # all places are held
                place = int(np.lexsort((numbers, scores))[0])
                if not (replace_worst and score[i] > scores[place]):
                    continue
                out[i] = numbers[place]
            exits[place], scores[place], numbers[place], taken[i] = leave[i], score[i], number[i], True
        # one form for equal states, whatever place a trade sits in
        held = np.where(exits > entry[-1], held, free)
        return {"taken": taken, "replaces": out}, held[:, np.lexsort((numbers, held[0]))].ravel().tolist()

    return run


def admit_slots(trades: DataFrame, cap: int = 2, replace_worst: bool = False, book: str = BOOK) -> DataFrame:
    """First come first served into ``cap`` slots, or replacing the worst open score.

    Trades are numbered per book in entry order; ``replaces`` is the ordinal of the trade thrown out.
    """
    return fold(trades, _slots(cap, replace_worst), ["idx", "entry", "exit", "score"], {"taken": "boolean", "replaces": "double"},
                key=book, keep=["entry", "exit", "score"])


def _positions(cooldown: int, allow_reverse: bool, same_bar: bool):
    """From one trade taken to the next by search, then the reason of everything in between at once."""

    def run(a, state):
        decision, leave, side = (np.asarray(a[k], float) for k in ("decision", "exit", "side"))
        n = len(decision)
        until, held, ended = state if state else (-2.0, 0.0, 0.0)
        status, i = np.full(n, "in_position", dtype=object), 0
        while i < n:
            if ended:
                status[i:] = "data_ended_open"
                break
            rest = decision[i:]
            late = i + int(np.searchsorted(rest, until, side="right"))  # the first after the exit
            ready = max(late, i + int(np.searchsorted(rest, until + cooldown)))
            exit_bar = i + int(np.searchsorted(rest, until))
            take = ready
            if allow_reverse and held:
                turn = np.flatnonzero(side[i : late if same_bar else exit_bar] != held)
                take = i + int(turn[0]) if len(turn) else ready
            if not same_bar:
                status[exit_bar : min(late, take)] = "same_bar_after_exit"
            status[late:take] = "cooldown"
            if take < n:
                status[take] = "taken"
                until, held, ended = leave[take], side[take], float(leave[take] < 0)
            i = take + 1
        return {"status": status}, [until, held, ended]

    return run


def state_machine(signals: DataFrame, cooldown: int = 0, allow_reverse: bool = False, same_bar: bool = False, key: str = "symbol") -> DataFrame:
    """One position at a time; each signal is taken or skipped with a reason.

    ``signals`` is numbered per symbol in decision order (ties by priority, then side) with
    ``decision``, ``exit`` (-1: still open at the end) and ``side`` (±1).
    """
    return fold(signals, _positions(cooldown, allow_reverse, same_bar), ["decision", "exit", "side"], {"status": "string"}, key=key,
                keep=["decision", "exit", "side"])


def _brake(limit: float, pause: int):
    def run(a, state):
        eq, peak, until = state if state else (0.0, 0.0, -1.0)
        live, used = [], []
        for i in range(len(a["r"])):
            t, r = float(a["idx"][i]), float(a["r"][i])
            on = t >= until
            gain = r if on else 0.0
            eq += gain
            peak = max(peak, eq)
            if on and peak - eq >= limit:
                until, peak = t + 1 + pause, eq
            live.append(on)
            used.append(gain)
        return {"active": live, "r_used": used}, [eq, peak, until]

    return run


def drawdown_brake(stream: DataFrame, limit: float, pause: int, book: str = BOOK) -> DataFrame:
    """Stop trading for ``pause`` bars after a fall of ``limit`` from the peak."""
    return fold(stream, _brake(limit, pause), ["idx", "r"], {"active": "boolean", "r_used": "double"}, key=book, keep=["r"])


def correlation_clusters(panel: DataFrame, limit: float = 0.8, by: str = "idx", asset: str = "symbol", x: str = "r", cap: int = 2) -> DataFrame:
    """Assets joined by correlations above ``limit``, labelled by the smallest member, with the cap per cluster.

    The smallest label spreads along edges until nothing changes; the edge list is at most assets².
    """
    half = settled(correlations(panel, by, asset, x).filter((c("rho") > limit) | (c("a") == c("b"))).select("a", "b"))
    edges = half.unionByName(half.filter("a != b").select(c("b").alias("a"), c("a").alias("b")))
    labels = edges.groupBy("a").agg(F.min("b").alias("label"))
    while True:
        nxt = settled(edges.join(labels.select(c("a").alias("b"), c("label").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("label")))
        changed = nxt.join(labels.select("a", c("label").alias("_o")), "a").filter("label != _o")
        labels = nxt
        if changed.isEmpty():
            break
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    return labels.join(size, "label").select(c("a").alias("asset"), c("label").alias("cluster"), "members", F.least("members", F.lit(cap)).alias("cap"))
