"""Registry of queries with their SQL twins, and a small SQL text builder for the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import Frame
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
NUDGE = 1.1e-9
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        register(name, fn, sql)
        return fn

    return wrap


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; tiny values of either sign become plain zero.

    The nudge moves exact decimal ties off the rounding edge, where the last bit of
    a float sum would decide.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < 0.5 * 10**-digits, 0.0).otherwise(F.round(x + NUDGE, digits))


def rounded(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[r6(c, digits).alias(c) for c in cols])


# -- SQL text ---------------------------------------------------------------
def sr(x: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({x}) < 0.5e-{digits} THEN 0.0::DOUBLE ELSE round(({x})::DOUBLE + 1.1e-9::DOUBLE, {digits}) END"


def bars_sql(every_ms: int = 3_600_000) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM (
    SELECT event_type AS symbol, (epoch_ms(ts) // {every_ms}) * {every_ms} AS ts,
           first(value ORDER BY events.ts, event_id) AS o, max(value) AS h, min(value) AS l,
           last(value ORDER BY events.ts, event_id) AS c, count(*)::DOUBLE AS v
    FROM events GROUP BY event_type, (epoch_ms(ts) // {every_ms}) * {every_ms})"""


USERS_SQL = """
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM (
    SELECT user_id AS symbol, (epoch_ms(ts) // 86400000) * 86400000 AS ts,
           first(value ORDER BY events.ts, event_id) AS o, max(value) AS h, min(value) AS l,
           last(value ORDER BY events.ts, event_id) AS c, count(*)::DOUBLE AS v
    FROM events GROUP BY user_id, (epoch_ms(ts) // 86400000) * 86400000)"""


def brands_sql(every_ms: int = 604_800_000) -> str:
    shift = 345_600_000 if every_ms == 604_800_000 else 0
    ts = f"((epoch_ms(l_shipdate) - {shift}) // {every_ms}) * {every_ms} + {shift}"
    order = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    p = "l_extendedprice / l_quantity"
    return f"""
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM (
    SELECT p_brand AS symbol, {ts} AS ts, first({p} ORDER BY {order}) AS o, max({p}) AS h, min({p}) AS l,
           last({p} ORDER BY {order}) AS c, sum(l_quantity) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, {ts})"""


def win(n: int, lag: int = 0) -> str:
    end = "CURRENT ROW" if lag == 0 else f"{lag} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1 + lag} PRECEDING AND {end})"


ORD = "(PARTITION BY symbol ORDER BY idx)"


def full(agg: str, x: str, n: int, lag: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {win(n, lag)} = {n} THEN {agg} OVER {win(n, lag)} END"


def avg(x: str, n: int) -> str:
    return full(f"avg({x})", x, n)


def mx(x: str, n: int) -> str:
    return full(f"max({x})", x, n)


def mn(x: str, n: int) -> str:
    return full(f"min({x})", x, n)


def sm(x: str, n: int) -> str:
    return full(f"sum({x})", x, n)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {ORD}"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"


def dot_sql(x: str, weights: list[float]) -> str:
    n = len(weights)
    parts = [f"({'' if k == 0 else 'lag('}{x}{'' if k == 0 else f', {k}) OVER {ORD}'}) * {weights[n - 1 - k]!r}::DOUBLE"
             for k in range(n)]
    return "(" + " + ".join(parts) + ")"


class Sql:
    """A chain of common table expressions, each adding columns to the previous one."""

    def __init__(self, source: str | None = None):
        self.parts = [("b0", source or bars_sql())]

    @property
    def last(self) -> str:
        return self.parts[-1][0]

    def step(self, text: str) -> "Sql":
        self.parts.append((f"b{len(self.parts)}", text))
        return self

    def add(self, **cols: str) -> "Sql":
        have = "*"
        return self.step(f"SELECT {have}, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {self.last}")

    def recur(self, name: str, b: str, a: float, start: int) -> "Sql":
        """``y[t] = a*y[t-1] + b[t]`` from ``start``, written out as a weighted sum of all past b."""
        src = self.last
        return self.step(
            f"SELECT s0.*, e.v AS {name} FROM {src} s0 LEFT JOIN (SELECT t.symbol, t.idx, "
            f"sum(s.bb * pow({a!r}::DOUBLE, t.idx - s.idx)) AS v FROM {src} t JOIN (SELECT symbol, idx, {b} AS bb "
            f"FROM {src}) s ON s.symbol = t.symbol AND s.idx <= t.idx AND s.idx >= {start} "
            f"WHERE t.idx >= {start} GROUP BY t.symbol, t.idx) e ON e.symbol = s0.symbol AND e.idx = s0.idx"
        )

    def _smooth(self, name: str, x: str, n: int, alpha: float, first: int) -> "Sql":
        start = first + n - 1
        seed = f"avg({x}) OVER {win(n)}"
        return self.recur(name, f"CASE WHEN idx = {start} THEN {seed} ELSE {alpha!r}::DOUBLE * {x} END", 1 - alpha, start)

    def ema(self, name: str, x: str, n: int, first: int = 0) -> "Sql":
        return self._smooth(name, x, n, 2 / (n + 1), first)

    def rma(self, name: str, x: str, n: int, first: int = 0) -> "Sql":
        return self._smooth(name, x, n, 1 / n, first)

    def loop(self, name: str, seed: str, step: str, start: int = 0, inputs: str = "*") -> "Sql":
        """A general recursion bar by bar: ``step`` may use ``p.<name>`` (previous) and ``n.<col>`` (this bar)."""
        src, i = self.last, len(self.parts)
        self.parts.append((f"b{i}r", f"SELECT symbol, idx, ({seed})::DOUBLE AS {name} FROM {src} n WHERE idx = {start} "
                           f"UNION ALL SELECT n.symbol, n.idx, ({step})::DOUBLE FROM b{i}r p JOIN {src} n "
                           f"ON n.symbol = p.symbol AND n.idx = p.idx + 1"))
        self.parts.append((f"b{i}", f"SELECT s0.*, r.{name} FROM {src} s0 LEFT JOIN b{i}r r "
                           f"ON r.symbol = s0.symbol AND r.idx = s0.idx"))
        return self

    def text(self, final: str) -> str:
        out = []
        for n, t in self.parts:
            out.append(f"{n} AS {'' if n.endswith('r') else 'MATERIALIZED '}({t})")
        return "WITH RECURSIVE " + ",\n".join(out) + "\n" + final.replace("$", self.last)

    def out(self, *cols: str, digits: int = 6, where: str = "") -> str:
        picked = ", ".join(f"{sr(c, digits)} AS {c}" for c in cols)
        return self.text(f"SELECT symbol, idx, {picked} FROM $ {where}")


SHORT = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}


def framed(spark: SparkSession, sf_dir: str, back: int, ahead: int = 0, size: int | None = None) -> Frame:
    return Frame.of_numbered(T.bars(spark, sf_dir), back, ahead, size)


# name -> (back, ahead, build, output columns), for the chunk and prefix tests
INDICATORS: dict[str, tuple] = {}


def indicator(name: str, back: int, build, outs: list[str], sql: str | None, ahead: int = 0, digits: int = 6,
              size: int | None = None) -> None:
    """Register an indicator over the hourly event bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(framed(spark, sf_dir, back, ahead, size)).core(), ["symbol", "idx"], outs, digits)

    INDICATORS[name] = (back, ahead, build, outs)
    register(name, run, sql)


def table_indicator(name: str, build, outs: list[str], sql: str | None, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(T.bars(spark, sf_dir)), ["symbol", "idx"], outs, digits)

    register(name, run, sql)
