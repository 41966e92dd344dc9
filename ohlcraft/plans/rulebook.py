"""From bars to a verdict: the flagship plan, one lazy DataFrame per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.averages import sma
from ..functions.volatility import atr
from ..operators.frames import Frame
from . import portfolio as P
from .outcomes import r_exit
from .signals import Rule, crosses, entries

c = F.col


def average_cross(numbered: DataFrame, fast: int = 5, slow: int = 20, atr_n: int = 14) -> DataFrame:
    """Bars with two averages, their crosses, and an ATR."""
    f = Frame.of_numbered(numbered, back=max(slow, atr_n) + 1)
    f = sma(sma(f, "fast", n=fast), "slow", n=slow)
    f = atr(f, "atr", atr_n, "sma")
    return crosses(f, "fast", "slow").core(*numbered.columns, "fast", "slow", "atr", "cross_up", "cross_down")


def cross_rule(horizon: int = 24, target_r: float = 3.0, k_atr: float = 2.0, warmup: int = 30) -> Rule:
    return Rule("average_cross", c("cross_up"), c("cross_down"), k_atr=k_atr, target_r=target_r, horizon=horizon, warmup=warmup)


def trades_of(rows: DataFrame, bars: DataFrame, rule: Rule) -> DataFrame:
    return r_exit(entries(rows, rule), bars, ["symbol", "idx"], rule.target_r, rule.horizon, rule.fee)


def on_grid(trades: DataFrame, bars: DataFrame, bar_ms: int) -> tuple[DataFrame, DataFrame]:
    """Trades with entry and exit as global bar numbers ``e0``, ``e1``, and the size of that grid.

    Both ends use the clock, so gaps in one symbol do not shift its trades.
    """
    ends = bars.agg(F.min("ts").alias("_g0"), F.max("ts").alias("_g1"))
    at = bars.select("symbol", c("idx").alias("exit_idx"), c("ts").alias("exit_ts"))
    t = trades.join(at, ["symbol", "exit_idx"], "left").crossJoin(F.broadcast(ends))
    t = t.withColumns({"e0": ((c("ts") - c("_g0")) / bar_ms).cast("long"), "e1": ((c("exit_ts") - c("_g0")) / bar_ms).cast("long")})
    n = ends.select(((c("_g1") - c("_g0")) / bar_ms + 1).cast("long").alias("n"))
    return t.drop("_g0", "_g1"), n


def metrics(trades: DataFrame, stream: DataFrame, lags: int = 50, block: int = 100, reps: int = 200, per_year: float = 24 * 365) -> DataFrame:
    """One row per book: trades, EV, robust Sharpe, drawdown, interval, concurrency, positive assets."""
    st = P.trade_stats(trades, [P.BOOK]).select(P.BOOK, c("n").alias("n_trades"), "ev", "t_stat", "profit_factor")
    pos = trades.groupBy(P.BOOK, "symbol").agg(F.avg("net").alias("_m")).groupBy(P.BOOK).agg(F.count_if(c("_m") > 0).alias("pos_assets"))
    out = st.join(pos, P.BOOK)
    for part in (P.nw_sharpe(stream, lags, per_year).drop("n"), P.drawdown(stream), P.block_bootstrap(stream, block, reps),
                 P.concurrency_stats(stream)):
        out = out.join(part, P.BOOK, "left")
    return out


def segments(trades: DataFrame, stream: DataFrame, n: DataFrame, share: float = 2 / 3) -> tuple[DataFrame, DataFrame]:
    """PRIMARY and F3 as books: trades by their entry bar, the stream by its bars.

    A trade that is open across the cut keeps accruing in the second segment.
    """
    cut = n.select(F.floor(c("n") * share).alias("_cut"))

    def name(at: str):
        return F.when(c(at) >= c("_cut"), "F3").otherwise("PRIMARY")

    t = trades.crossJoin(F.broadcast(cut)).withColumn(P.BOOK, name("e0")).drop("_cut")
    s = stream.crossJoin(F.broadcast(cut)).withColumn(P.BOOK, name("idx"))
    return t, s.withColumn("idx", F.when(c("idx") >= c("_cut"), c("idx") - c("_cut")).otherwise(c("idx"))).drop("_cut")
