"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document of a source whose target is ``rate`` times its size is taken
``floor(rate)`` times plus once more with probability ``rate - floor(rate)``. Those fractions are rounded together:
two documents trade words until one of them is settled, so a source's words stay at the target, and what is left of a
chunk is one open document. Open documents of many chunks meet in the next level of a reduction tree, down to one per
source, which a last draw settles. A source's words thus miss its target by less than one document.

Draws are hashes of (seed, key, step), and the order within a chunk is that of a hash, so reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order. A document of size 0 has nothing to
trade: its fraction is drawn alone and its words are 0 either way. Repeated rows are separate documents. An empty table
gives an empty result. Of a very long text only the number of its words moves. Other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, staged, text_of

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20_260_101
#: Documents in a chunk and open documents in a node of the tree.
FAN_IN = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key and size: the words of the text, counted as the matches of one pattern."""
    marks = F.regexp_replace(text_of(), f"[{BLANK}]*+[^{BLANK}]++", "x")
    return docs.select("doc_id", "source", F.xxhash64(text_of()).alias("text_key"),
                       F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long").alias("size"))


def targets(records: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources fill in the order of cap by weight: with the level ``x`` at which capped sources and ``x * weight`` for the
    rest add up to the total, a source's target is the smaller of its cap and ``x * weight``.
    """
    by = records.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.count("*").alias("source_rows"))
    number = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", share * F.sum("source_size").over(every)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the level of the first source in this order that isn't full holds for all after it
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull(), "source", "level"))).over(every)
    return by.withColumn("x", first["level"]).select(
        "source", F.col("source_size").cast("long").alias("source_size"), "source_rows",
        F.when(F.col("x").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("x") * F.col("weight"))).alias("target"))


def _draw(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "big"))


def pivot(p: np.ndarray, size: np.ndarray, draws: np.random.Generator) -> tuple[np.ndarray, int]:
    """Trade words between documents in the given order until one open document is left.

    With ``open`` at probability ``a`` of ``s`` words and the next at ``b`` of ``t``, either the open one gains what the
    next one loses, or the reverse, as far as a probability reaches 0 or 1; the chances of the two are such that
    expectations hold. ``a*s + b*t`` never changes. Returns the probabilities and the place of the open one (-1: none).
    """
    p, at = p.copy(), -1
    u = draws.random(len(p))
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if at < 0:
            at = i
            continue
        s, t = size[at], size[i]
        up = min((1 - p[at]) * s, p[i] * t)
        down = min(p[at] * s, (1 - p[i]) * t)
        words = up if u[i] * (up + down) < down else -down
        p[at] += words / s
        p[i] -= words / t
        for k in (at, i):
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = round(p[k])
        at = at if 0.0 < p[at] < 1.0 else i if 0.0 < p[i] < 1.0 else -1
    return p, at


def _settle(level: int, seed: int):
    """One node of the tree: settles all its documents but one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order_key", "ascending"), ("size", "ascending")])
        draws = _draw(seed, level, *(k.as_py() for k in key))
        p = rows["p"].to_numpy().astype(float)
        size = rows["size"].to_numpy().astype(float)
        lone = (size <= 0) & (p > 0) & (p < 1)
        p[lone] = draws.random(int(lone.sum())) < p[lone]
        p, at = pivot(p, size, draws)
        for name, values in (("p", p), ("settled", np.arange(len(p)) != at)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        return rows

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Every document with its size, its source's size and target, and the number of copies that the mix takes.

    Only keys and sizes are shuffled, into chunks of about ``FAN_IN`` documents, so a large source is many chunks.
    """
    records = staged(sizes(docs), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = staged(targets(records, weights, share, most).withColumn("rate", rate), "mix-targets").withColumnRenamed("source", "of")
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text_key"))
    chunks = F.ceil(F.col("source_rows") / FAN_IN)
    first = records.join(by, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "text_key", "size", "source_size", "target", F.floor("rate").cast("int").alias("whole"),
        F.xxhash64(F.col("of").isNull(), F.col("of")).alias("source_key"), order.alias("order_key"), F.pmod(order, chunks).alias("chunk"),
        (F.col("rate") - F.floor("rate")).alias("p"), F.lit(False).alias("settled"))
    first = staged(first.groupBy("source_key", "chunk").applyInArrow(_settle(0, seed), first.schema), "mix-level-0")
    nodes = by.select(F.max(F.ceil(F.col("source_rows") / FAN_IN))).first()[0] or 0
    state = first.filter("not settled").select("source_key", "chunk", F.col("chunk").alias("node"), F.col("chunk").alias("order_key"), "size", "p", "settled")
    level = 0
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // FAN_IN)
        state = state.withColumn("node", F.expr(f"node div {FAN_IN}"))
        open_ = state.filter("not settled")
        state = staged(state.filter("settled").unionByName(open_.groupBy("source_key", "node").applyInArrow(_settle(level, seed), state.schema)), f"mix-level-{level}")
    # the tree's top: one document per source at most is still open
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("top"), "source_key"), F.lit(1 << 53)) / float(1 << 53)
    late = state.select("source_key", "chunk", F.when(F.col("settled"), F.col("p")).otherwise((chance < F.col("p")).cast("double")).alias("late_p"))
    rows = first.filter("settled").withColumn("late_p", F.col("p")).unionByName(first.filter("not settled").join(late, ["source_key", "chunk"], "left"), allowMissingColumns=True)
    copies = F.col("whole") + F.coalesce(F.col("late_p"), F.col("p")).cast("int")
    return rows.select("doc_id", "text_key", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    plan = mix(docs, **options).groupBy(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__mix_doc"), F.col("text_key").alias("__mix_text")).agg(F.sort_array(F.collect_list("copies")).alias("__mix_copies"))
    own = docs.columns
    rows = docs.withColumn("__mix_doc", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__mix_text", F.xxhash64(text_of()))
    joined = rows.join(plan, ["__mix_doc", "__mix_text"])  # the window below finds the rows dealt out as it needs them
    joined = joined.withColumn("__mix_row", F.row_number().over(Window.partitionBy("__mix_doc", "__mix_text").orderBy(F.lit(1))))
    copies = F.element_at("__mix_copies", F.col("__mix_row"))
    return joined.filter(copies > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), copies))).select(*own)
