"""Linear recursions ``y[t] = a*y[t-1] + b[t]`` as windows over chunks.

Inside one chunk the recursion from a zero start is a running sum of ``b * a**-t``
scaled by ``a**t`` (the exponent is centred on the chunk so it cannot overflow).
Only one row per chunk, its closing value, goes through a small per-symbol pass
that gives every chunk its opening value; the rest of the solution is
``a**t * opening``. No per-row Python and no task per symbol.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .frames import Frame

_MAX_EXP = 690.0


@dataclass(frozen=True)
class Chain:
    """``depth`` equal exponential averages fed into each other.

    ``outs`` names the levels. Level 1 reads ``x``; level ``k`` reads level ``k-1``.
    Every level starts at ``start`` plus ``k-1`` times ``step`` with ``seed`` (the mean
    of its first ``length`` inputs, or the first input when ``length`` is 0).
    """

    outs: tuple[str, ...]
    x: Column
    a: float
    gain: float
    length: int
    start: int
    step: int = 0

    def starts(self) -> list[int]:
        return [self.start + k * self.step for k in range(len(self.outs))]


def ema_chain(outs, x: Column, n: int, first: int = 0) -> Chain:
    """SMA-seeded EMA; ``first`` is the ordinal of the first valid input."""
    return Chain(tuple(outs), x, 1 - 2 / (n + 1), 2 / (n + 1), n, first + n - 1, n - 1)


def rma_chain(outs, x: Column, n: int, first: int = 0) -> Chain:
    return Chain(tuple(outs), x, 1 - 1 / n, 1 / n, n, first + n - 1, n - 1)


def _response(gain: float, a: float, d: int, q: Column) -> Column:
    """What one unit at level l adds to level l+d after q steps."""
    coef = F.lit(gain**d / math.factorial(d))
    for i in range(d):
        coef = coef * (q + i)
    return coef * F.exp(q * math.log(a)) if a > 0 else F.lit(0.0)


def recur(frame: Frame, chains: list[Chain], warm: int = 0) -> Frame:
    """Add the columns of all ``chains`` to the frame with one carry join.

    ``warm`` is how many rows at the head of a chunk the inputs need before they are
    valid (their own look-back); it must not exceed ``frame.back``.
    """
    trivial = [c for c in chains if c.a <= 0]
    for c in trivial:
        frame = frame.add(**{o: F.when(F.col("idx") >= c.start, c.x) for o in c.outs})
    chains = [c for c in chains if c.a > 0]
    if not chains:
        return frame
    if warm > frame.back:
        raise ValueError(f"inputs reach {warm} rows back but the frame only {frame.back}")
    span = frame.size + frame.back + frame.ahead
    head = frame.size - frame.back + warm
    for c in chains:
        if max(c.starts()) >= head:
            raise ValueError(f"start-up of {c.outs} needs {max(c.starts())} rows; use larger chunks")
        if -math.log(c.a) * span / 2 > _MAX_EXP:
            raise ValueError(f"{c.outs}: decay too fast for chunks of {span} rows; use smaller chunks")

    idx, chunk = F.col("idx"), F.col("chunk")
    origin = F.when(chunk > 0, chunk * frame.size - frame.back + warm).otherwise(F.lit(0))
    frame = frame.add(_qrel=(idx - origin).cast("double"))
    rel = F.col("_qrel")
    mid = span / 2
    run = frame.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = max(len(c.outs) for c in chains)
    for level in range(depth):
        inputs, zero = {}, {}
        for i, c in enumerate(chains):
            if level >= len(c.outs):
                continue
            x = c.x if level == 0 else F.col(f"_qz{i}_{level - 1}")
            inputs[f"_qx{i}_{level}"] = x
        frame = frame.add(**inputs)
        for i, c in enumerate(chains):
            if level >= len(c.outs):
                continue
            x, start = F.col(f"_qx{i}_{level}"), c.starts()[level]
            if c.length:
                # only one row needs the mean, so a running sum of its inputs is enough
                part = F.when((idx > start - c.length) & (idx <= start), x)
                seed = F.when(F.count(part).over(run) == c.length, F.sum(part).over(run) / c.length)
            else:
                seed = x
            zero[f"_qb{i}_{level}"] = (
                F.when(rel < 0, 0.0).when(idx < start, 0.0).when(idx == start, seed).otherwise(c.gain * x)
            )
        frame = frame.add(**zero)
        sums = {}
        for i, c in enumerate(chains):
            if level >= len(c.outs):
                continue
            b, la = F.col(f"_qb{i}_{level}"), math.log(c.a)
            scaled = F.sum(b * F.exp((mid - rel) * la)).over(run)
            sums[f"_qz{i}_{level}"] = scaled * F.exp((rel - mid) * la)
            # a missing input makes every later value missing
            sums[f"_qn{i}_{level}"] = F.sum(F.when(b.isNull(), 1).otherwise(0)).over(run)
        frame = frame.add(**sums)

    names = [(i, k) for i, c in enumerate(chains) for k in range(len(c.outs))]
    closing = (idx == (chunk + 1) * frame.size - frame.back + warm - 1) & (rel >= 0)
    ends = frame.df.filter(closing).select(
        frame.key,
        (chunk + 1).alias("chunk"),
        F.struct(*[F.col(f"_qz{i}_{k}").alias(f"s{i}_{k}") for i, k in names]).alias("_s"),
        sum((F.col(f"_qn{i}_{k}") for i, k in names), F.lit(0)).alias("_bad"),
        *[F.col(f"_qn{i}_{k}").alias(f"_qm{i}_{k}") for i, k in names],
    )
    slow = max(c.a for c in chains)
    reach = int(_MAX_EXP / (-math.log(slow) * frame.size)) + 2
    by = Window.partitionBy(frame.key).orderBy("chunk")
    zero_state = F.struct(*[F.lit(0.0).alias(f"s{i}_{k}") for i, k in names])

    def advance(acc: Column, row: Column) -> Column:
        fields = []
        for i, c in enumerate(chains):
            for k in range(len(c.outs)):
                total = row[f"s{i}_{k}"]
                for j in range(k + 1):
                    carry = _response(c.gain, c.a, k - j, F.lit(float(frame.size)))
                    total = total + carry * acc[f"s{i}_{j}"]
                fields.append(F.coalesce(total, F.lit(0.0)).alias(f"s{i}_{k}"))
        return F.struct(*fields)

    opening = ends.select(
        frame.key,
        "chunk",
        F.aggregate(F.collect_list("_s").over(by.rowsBetween(-(reach - 1), 0)), zero_state, advance).alias("_qe"),
        *[
            F.sum(f"_qm{i}_{k}").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_qm{i}_{k}")
            for i, k in names
        ],
    )
    joined = frame.df.join(opening, [frame.key, "chunk"], "left")
    cols = {}
    for i, c in enumerate(chains):
        for k, out in enumerate(c.outs):
            value = F.col(f"_qz{i}_{k}")
            for j in range(k + 1):
                value = value + F.coalesce(_response(c.gain, c.a, k - j, rel + 1) * F.col(f"_qe.s{i}_{j}"), F.lit(0.0))
            bad = F.col(f"_qn{i}_{k}") + F.coalesce(F.col(f"_qm{i}_{k}"), F.lit(0))
            cols[out] = F.when((idx >= c.starts()[k]) & (rel >= 0) & (bad == 0), value)
    out = joined.withColumns(cols)
    drop = ["_qrel", "_qe"] + [f"_q{p}{i}_{k}" for p in "xbznm" for i, k in names]
    return replace(frame, df=out.drop(*drop))


def recur_varying(frame: Frame, out: str, a: Column, b: Column, start: int, slowest_decay: float, warm: int = 0) -> Frame:
    """``y[t] = a[t]*y[t-1] + b[t]`` with a coefficient in ``[slowest_decay, 1]``.

    ``b`` at ordinal ``start`` is the seed. The closing values are composed per
    symbol by a small pandas pass: one row per chunk of ``frame.size`` bars.
    """
    span = frame.size + frame.back + frame.ahead
    if -math.log(slowest_decay) * span > _MAX_EXP:
        raise ValueError("coefficient too small for this chunk size; use smaller chunks")
    idx, chunk = F.col("idx"), F.col("chunk")
    origin = F.when(chunk > 0, chunk * frame.size - frame.back + warm).otherwise(F.lit(0))
    live = (idx >= origin) & (idx >= start)
    frame = frame.add(_qin=live)
    frame = frame.add(
        _qla=F.when(F.col("_qin") & (idx > start), F.log(a)).otherwise(0.0),
        _qb=F.when(F.col("_qin"), b).otherwise(0.0),
    )
    run = frame.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = frame.add(_qL=F.sum("_qla").over(run))
    frame = frame.add(_qz=F.exp("_qL") * F.sum(F.col("_qb") * F.exp(-F.col("_qL"))).over(run))
    closing = (idx == (chunk + 1) * frame.size - frame.back + warm - 1) & F.col("_qin")
    ends = frame.df.filter(closing).select(
        F.col(frame.key).alias("k"), (chunk + 1).alias("chunk"), F.col("_qz").alias("s"), F.exp("_qL").alias("g")
    )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        value, opened = 0.0, []
        for s, g in zip(pdf["s"], pdf["g"]):
            value = s + g * value
            opened.append(value)
        return pd.DataFrame({"k": pdf["k"], "chunk": pdf["chunk"], "_qe": opened})

    key_type = ends.schema["k"].dataType.simpleString()
    opening = (
        ends.groupBy("k").applyInPandas(compose, f"k {key_type}, chunk long, _qe double").withColumnRenamed("k", frame.key)
    )
    joined = frame.df.join(opening, [frame.key, "chunk"], "left")
    value = F.col("_qz") + F.coalesce(F.exp("_qL") * F.col("_qe"), F.lit(0.0))
    df = joined.withColumn(out, F.when(F.col("_qin"), value)).drop("_qin", "_qla", "_qb", "_qL", "_qz", "_qe")
    return replace(frame, df=df)
