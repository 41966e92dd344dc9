"""Indicators by name: builder, outputs, parameters with their ranges, and bars needed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames
from ..operators.frames import Frame
from . import averages as A
from . import candles as C
from . import momentum as M
from . import statistics as S
from . import volatility as V


@dataclass(frozen=True)
class Spec:
    """``params`` maps a name to (default, low, high); ``back`` gives the rows a frame must reach back, ``size`` its chunks' rows.

    Chunks must hold the start-up of a recursion and keep its decay within the range of a double. The default does for
    averages, whose decay slows down as their start-up grows.
    """

    build: Callable[..., Frame]
    outputs: tuple[str, ...]
    params: dict[str, tuple[float, float | None, float | None]] = field(default_factory=dict)
    back: Callable[[dict], int] = lambda p: 0
    recursive: bool = False
    size: Callable[[dict], int] | None = None

    def chunk(self, p: dict) -> int | None:
        if self.size is not None:
            return self.size(p)
        longest = max([int(v) for v in p.values()], default=0) if self.recursive else 0
        return max(frames.SIZE, 8 * longest + self.back(p))


def _vidya_size(p: dict) -> int:
    """As large as the fastest decay, ``1 - 2 / (n + 1)``, allows."""
    n = int(p["n"])
    return min(max(frames.SIZE, 10 * n), int(650 / -log(1 - 2 / (n + 1))) - 2 * n - 4)


def _n(default: int, low: int = 1, high: int = 500) -> dict:
    return {"n": (default, low, high)}


def _average(fn, default: int, factor: int = 1, recursive: bool = False) -> Spec:
    return Spec(lambda f, n: fn(f, "value", "close", int(n)), ("value",), _n(default, 2), lambda p: int(factor * p["n"]) + 2, recursive)


def _simple(fn, outputs: tuple[str, ...], default: int, factor: int = 1, recursive: bool = False) -> Spec:
    return Spec(lambda f, n: fn(f, int(n)), outputs, _n(default, 2), lambda p: int(factor * p["n"]) + 2, recursive)


CATALOG: dict[str, Spec] = {
    **{k: _average(fn, d, 2) for k, fn, d in (("sma", A.sma, 10), ("wma", A.wma, 10), ("fwma", A.fwma, 10), ("pwma", A.pwma, 10), ("sinwma", A.sinwma, 14),
                                              ("swma", A.swma, 10), ("alma", A.alma, 9), ("trima", A.trima, 10), ("hma", A.hma, 10), ("linreg", A.linreg, 14), ("midpoint", A.midpoint, 2))},
    **{k: _average(fn, 10, 2, True) for k, fn in (("ema", A.ema), ("rma", A.rma), ("smma", A.smma), ("dema", A.dema), ("tema", A.tema), ("t3", A.t3), ("zlma", A.zlma))},
    # at its fastest a step keeps 1 - (2 / 3) ** 2 of the value, whatever n
    "kama": replace(_average(A.kama, 10, 1, True), size=lambda p: 600),
    "vidya": replace(_average(A.vidya, 14, 2, True), size=_vidya_size),
    **{k: _simple(fn, outs, d, 1) for k, fn, outs, d in (
        ("bias", M.bias, ("bias",), 26), ("brar", M.brar, ("ar", "br"), 26), ("cci", M.cci, ("cci",), 14), ("cfo", M.cfo, ("cfo",), 9), ("cg", M.cg, ("cg",), 10),
        ("cmo", M.cmo, ("cmo",), 14), ("er", M.er, ("er",), 10), ("psl", M.psl, ("psl",), 12), ("roc", M.roc, ("roc",), 10), ("willr", M.willr, ("willr",), 14),
        ("entropy", S.entropy, ("entropy",), 10), ("kurtosis", S.kurtosis, ("kurtosis",), 30), ("mad", S.mad, ("mad",), 30), ("median", S.median, ("median",), 30),
        ("quantile", S.quantile, ("quantile",), 30), ("skew", S.skew, ("skew",), 30), ("stdev", S.stdev, ("close_stdev",), 30), ("variance", S.variance, ("variance",), 30),
        ("zscore", S.zscore, ("zscore",), 30), ("accbands", V.accbands, ("lower", "mid", "upper"), 20),
        ("bbands", V.bbands, ("lower", "mid", "upper", "bandwidth", "percent_b"), 20), ("vwma", V.vwma, ("vwma",), 10))},
    **{k: _simple(fn, outs, d, 2, True) for k, fn, outs, d in (
        ("rsi", M.rsi, ("rsi",), 14), ("pgo", M.pgo, ("pgo",), 14), ("fisher", M.fisher, ("fisher", "signal"), 9), ("adx", V.adx, ("adx", "adxr", "dmp", "dmn"), 14),
        ("rwi", V.rwi, ("rwi_high", "rwi_low"), 14))},
    "atr": Spec(lambda f, n: V.atr(f, "atr", int(n)), ("atr",), _n(14), lambda p: int(p["n"]) + 2, True),
    "true_range": Spec(V.true_range, ("true_range",), back=lambda p: 2),
    "ao": Spec(M.ao, ("ao",), back=lambda p: 36),
    "apo": Spec(M.apo, ("apo",), back=lambda p: 30),
    "bop": Spec(M.bop, ("bop",)),
    "coppock": Spec(M.coppock, ("coppock",), back=lambda p: 30),
    "kst": Spec(M.kst, ("kst", "signal"), back=lambda p: 60),
    "stoch": Spec(M.stoch, ("stoch_k", "stoch_d"), back=lambda p: 24),
    "stochf": Spec(M.stochf, ("stoch_k", "stoch_d"), back=lambda p: 20),
    "uo": Spec(M.uo, ("uo",), back=lambda p: 32),
    "macd": Spec(lambda f, fast, slow, signal: M.macd(f, int(fast), int(slow), int(signal)), ("macd", "signal", "hist"),
                 {"fast": (12, 1, 200), "slow": (26, 1, 400), "signal": (9, 1, 200)}, lambda p: 40, True),
    "ppo": Spec(M.ppo, ("ppo", "signal", "hist"), back=lambda p: 40, recursive=True),
    "stochrsi": Spec(M.stochrsi, ("stoch_k", "stoch_d"), back=lambda p: 40, recursive=True),
    "heikin_ashi": Spec(V.heikin_ashi, ("ha_open", "ha_high", "ha_low", "ha_close"), back=lambda p: 4, recursive=True),
    "hilo": Spec(V.hilo, ("hilo",), back=lambda p: 50, recursive=True),
    "doji": Spec(C.doji, ("doji",), back=lambda p: 12),
    **{f"cdl_{k}": Spec(lambda f, k=k: C.candle(f, k, f"cdl_{k}"), (f"cdl_{k}",), back=lambda p: 6) for k in C.PATTERNS if not k.startswith("hikkake")},
}

# its smoothing halves the value at every step whatever n, so its frames reach back no further than they must
CATALOG["fisher"] = replace(CATALOG["fisher"], back=lambda p: int(p["n"]) + 2, size=lambda p: frames.SIZE)


def register(name: str, spec: Spec) -> None:
    """Add a user's own indicator; an existing name is not replaced."""
    if name in CATALOG:
        raise ValueError(f"{name} exists already")
    CATALOG[name] = spec


def resolve(name: str, *chain: dict[str, Spec]) -> Spec:
    """First catalog of the chain that knows the name; the built-in one comes last."""
    for cat in (*chain, CATALOG):
        if name in cat:
            return cat[name]
    raise KeyError(f"unknown indicator {name!r}")


def parameters(name: str, given: dict | None = None, *chain: dict[str, Spec]) -> dict:
    """Defaults overlaid by the given values, checked against the ranges."""
    spec, given = resolve(name, *chain), given or {}
    if set(given) - set(spec.params):
        raise ValueError(f"{name}: unknown parameters {sorted(set(given) - set(spec.params))}")
    out = {k: given.get(k, default) for k, (default, _, _) in spec.params.items()}
    for k, (_, low, high) in spec.params.items():
        if low is not None and out[k] < low or high is not None and out[k] > high:
            raise ValueError(f"{name}: {k}={out[k]} outside [{low}, {high}]")
    return out


def compute(numbered: DataFrame, name: str, given: dict | None = None, *chain: dict[str, Spec]) -> DataFrame:
    """One indicator as columns ``name_output`` beside ``symbol`` and ``idx``."""
    spec = resolve(name, *chain)
    p = parameters(name, given, *chain)
    f = spec.build(Frame.of_numbered(numbered, spec.back(p), size=spec.chunk(p)), **p)
    return f.core("symbol", "idx", *[F.col(o).cast("double").alias(f"{name}_{o}") for o in spec.outputs])


def bulk(numbered: DataFrame, names: list[str] | None = None, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Every indicator in long form ``(symbol, idx, column, value)``: branches run side by side, nothing is joined."""
    parts = []
    for name in names or sorted(CATALOG):
        one = compute(numbered, name, (overrides or {}).get(name))
        cols = [x for x in one.columns if x not in ("symbol", "idx")]
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("value")) for x in cols]))
        parts.append(one.select("symbol", "idx", pairs.alias("_p")).select("symbol", "idx", "_p.column", "_p.value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rules_at(rows: DataFrame, events: DataFrame, named: dict, key: tuple[str, ...] = ("symbol", "idx")) -> DataFrame:
    """Named expressions evaluated on the event bars only."""
    return rows.join(events.select(*key), list(key), "left_semi").select(*key, *[e.alias(n) for n, e in named.items()])
