"""Non-linear state carried along a symbol, run chunk by chunk in parallel.

Each chunk starts cold on the ``warmup`` bars before it and then runs its own bars.
Where the state it arrived with equals the state the previous chunk left with, the
chunk is settled; the others are run again from the previous chunk's closing state,
until every seam agrees. A forgetting recursion settles in the first round, a stubborn
one takes more rounds, and the result is that of the sequential loop either way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_dir
from .frames import KEY, Frame

Arrays = dict[str, np.ndarray]
# kernel(columns, state or None) -> (output columns, closing state)
Kernel = Callable[[Arrays, list[float] | None], tuple[Arrays, list[float]]]

TOLERANCE = 1e-12
SIZE = 4096


def fold(
    numbered: DataFrame,
    kernel: Kernel,
    inputs: list[str],
    outputs: dict[str, str],
    warmup: int = 512,
    size: int | None = None,
    key: str = KEY,
    keep: list[str] | None = None,
) -> DataFrame:
    """Run ``kernel`` over each symbol in ``idx`` order.

    ``outputs`` maps output names to SQL types; ``keep`` lists input columns to return.
    """
    keep, size = list(keep or []), size or SIZE
    cols = list(dict.fromkeys(["idx", *inputs, *keep]))
    frame = Frame.of_numbered(numbered.select(key, *cols), back=warmup, size=size, key=key)
    key_type = numbered.schema[key].dataType.simpleString()
    kept = "".join(f", {c} {numbered.schema[c].dataType.simpleString()}" for c in keep if c != "idx")
    made = "".join(f", {o} {t}" for o, t in outputs.items())
    schema = f"{key} {key_type}, chunk long, idx long{kept}{made}, _in array<double>, _out array<double>"
    out_cols = [key, "chunk", "idx", *[c for c in keep if c != "idx"], *outputs]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        edge = int(pdf["chunk"].iloc[0]) * size
        own = pdf[pdf["idx"] >= edge]
        state = None
        given = pdf["_given"].iloc[0] if "_given" in pdf.columns else None
        if given is not None:
            state = [float(v) for v in given]
        elif len(own) < len(pdf):
            head = pdf[pdf["idx"] < edge]
            _, state = kernel({c: head[c].to_numpy() for c in inputs}, None)
        if own.empty:
            # a chunk of warm-up bars alone; object columns take any type of the schema
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*out_cols, "_in", "_out"]})
        opened = state
        made, closed = kernel({c: own[c].to_numpy() for c in inputs}, state)
        out = own[[key, "chunk", "idx", *[c for c in keep if c != "idx"]]].copy()
        for name in outputs:
            out[name] = made[name]
        n = len(out)
        out["_in"] = pd.Series([opened] + [None] * (n - 1), index=out.index, dtype=object)
        out["_out"] = pd.Series([None] * (n - 1) + [list(closed)], index=out.index, dtype=object)
        return out

    base = f"{shared_dir(numbered.sparkSession)}/ohlcraft/fold-{uuid.uuid4().hex}"

    def save(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{base}/{step}")
        return df.sparkSession.read.parquet(f"{base}/{step}").withColumn("_step", F.lit(step))

    def seams_of(rows: DataFrame) -> DataFrame:
        ends = rows.filter(F.col("_in").isNotNull() | F.col("_out").isNotNull())
        return ends.groupBy(key, "chunk").agg(
            F.first("_in", ignorenulls=True).alias("_in"), F.first("_out", ignorenulls=True).alias("_out"), F.max("_step").alias("_step")
        )

    # each round writes the chunks that it repaired and nothing else
    rounds = [save(frame.df.groupBy(key, "chunk").applyInPandas(run, schema), 0)]
    by = Window.partitionBy(key).orderBy("chunk")
    differs = F.exists(
        F.arrays_zip("_in", "_prev"),
        lambda p: ~(F.abs(p["_in"] - p["_prev"]) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(p["_prev"])))
        & ~(F.isnan(p["_in"]) & F.isnan(p["_prev"])),
    )
    seams = seams_of(rounds[0])
    while not rounds[0].filter(F.col("chunk") > 0).isEmpty():
        known = seams.withColumn("_prev", F.lag("_out").over(by))
        open_seams = known.filter(F.col("_prev").isNotNull() & (F.col("_in").isNull() | differs)).select(
            key, "chunk", F.col("_prev").alias("_given")
        )
        if open_seams.isEmpty():
            break
        again = frame.df.filter(frame.is_core).join(open_seams, [key, "chunk"])
        rounds.append(save(again.groupBy(key, "chunk").applyInPandas(run, schema), len(rounds)))
        seams = reduce(DataFrame.unionByName, [seams_of(r) for r in rounds])
        seams = seams.groupBy(key, "chunk").agg(F.max_by(F.struct("_in", "_out"), "_step").alias("_s"), F.max("_step").alias("_step")).select(
            key, "chunk", "_s.*", "_step"
        )
    rows = reduce(DataFrame.unionByName, rounds)
    if len(rounds) > 1:  # a chunk's rows are those of its last round
        rows = rows.join(seams.select(key, "chunk", "_step"), [key, "chunk", "_step"], "left_semi")
    return rows.select(*out_cols).drop("chunk")
