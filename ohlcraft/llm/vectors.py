"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction made of one code word for either half of the coordinates of a randomly turned space, so ``words``
code words each give ``words ** 2`` directions; ``TURNS`` such codes are independent. A vector passes the filters whose
direction exceeds a cosine; list decoding finds all of them from the best words of either half, without looking at every
direction. Two vectors of high cosine pass a common filter with high probability; vectors of a common filter are compared in
double precision, in blocks, and pairs are never written out.

The number of code words and the cosine follow from the number of vectors: a filter is passed by ``CROWD`` unrelated vectors
and a vector passes ``PASSED`` filters of a turn on average, at every size. A filter with many vectors is cut into blocks of ``BLOCK``, and
every pair of blocks is a piece of work of its own. A pair is counted at its first common filter.

Equal vectors are one vector with a number of copies. Vectors of unequal length never link. Null, empty or zero vectors, and
those with null or non-finite components, link with nothing; neither do rows with a null id, whose component is null.
Repeated rows are vectors of their own. An empty table gives an empty result. Other columns may have any name: only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, runs_of, smallest_linked, staged, whole_runs
from .graph import components

COSINE = 0.95
#: Directions are drawn in at least this many dimensions; shorter vectors are turned into that space.
LEAST_DIMENSIONS = 64
TURNS = 10
PASSED = 8
CROWD = 0.1
BLOCK = 256
#: Random vectors that the cosine of the filters is fitted on.
PROBES = 64
SEED = 6


class Code:
    """One turn's product code for vectors of one length: every pair of a code word for either half is a direction."""

    def __init__(self, length: int, n: int, turn: int = 0):
        share = min(0.05, CROWD / max(n, 1))
        self.words = max(8, round((PASSED / share) ** 0.5))
        half = -(-max(LEAST_DIMENSIONS, length) // 2)
        draws = np.random.default_rng([SEED, turn, length, self.words])
        axes = np.linalg.qr(draws.standard_normal((2 * half, length)))[0].reshape(2, half, length)
        words = draws.standard_normal((2, self.words, half))
        words /= np.linalg.norm(words, axis=2, keepdims=True)
        #: Inner products of a vector with all words of both halves, after a random turn of the space.
        self.code = np.concatenate([w @ a for w, a in zip(words, axes, strict=True)]).T
        # the sum of two inner products that PASSED directions exceed on average, found on random vectors
        probes = draws.standard_normal((PROBES, length))
        probes /= np.linalg.norm(probes, axis=1, keepdims=True)
        low, high = 0.0, 2.0
        for _ in range(14):
            self.least = (low + high) / 2
            passed = np.mean([len(f) for f in self.decode(probes)])
            low, high = (self.least, high) if passed > PASSED else (low, self.least)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """For each row all directions that it exceeds, found from the best words of either half."""
        sums = units @ self.code
        out = []
        for one, two in zip(sums[:, : self.words], sums[:, self.words :], strict=True):
            i, j = np.flatnonzero(one >= self.least - two.max()), np.flatnonzero(two >= self.least - one.max())
            j = j[np.argsort(-two[j], kind="stable")]
            ends = np.searchsorted(-two[j], one[i] - self.least, side="right")
            out.append(np.repeat(i, ends) * self.words + j[np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)])
        return out


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """rep (smallest id), copies and embedding of each different usable vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return usable.select("vec_id", F.col("embedding").alias("v")).groupBy("v").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def with_filters(reps: DataFrame, n: int) -> DataFrame:
    """Add the filters that each vector passes; a filter's number includes the vectors' length."""

    def make():
        codes: dict[int, list[Code]] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(0).to_pylist()
            found: list = [None] * len(rows)
            for length in {len(v) for v in rows}:
                at = [i for i, v in enumerate(rows) if len(v) == length]
                if length not in codes:
                    codes[length] = [Code(length, n, t) for t in range(TURNS)]
                x = np.array([rows[i] for i in at], float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for k in range(0, len(at), 512):
                    turns = [[f + (((length << 8) | t) << 40) for f in code.decode(x[k : k + 512])] for t, code in enumerate(codes[length])]
                    for i, parts in zip(at[k : k + 512], zip(*turns, strict=True), strict=True):
                        found[i] = np.sort(np.concatenate(parts))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

        return step

    schema = reps.select("v", "rep", "copies", F.expr("cast(array() as array<long>)").alias("filters")).schema
    return map_rows(reps.select("v", "rep", "copies"), make, schema)



def compare(rep: np.ndarray, copies: np.ndarray, unit: np.ndarray, side: np.ndarray, seen: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that this piece counts, and the smallest rep that links reach from it.

    ``side`` says which of the two blocks a row is from: rows of different blocks are compared, or all where there is one.
    ``seen`` marks, per row, earlier filters; rows that share one are counted there.
    """
    link = unit @ unit.T >= cosine
    np.fill_diagonal(link, False)
    if side.min() != side.max():
        link &= side[:, None] != side[None, :]
    fresh = link & ~(seen @ seen.T > 0) if seen.shape[1] else link
    return fresh @ copies, rep[smallest_linked(link)]


def link_pieces(rows: DataFrame, cosine: float) -> DataFrame:
    """Compare what meets in a filter: rep, links counted and the root of each row with a link."""
    keys = ["filter", "one", "two"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "rep")
    schema = "rep long, links long, root long"
    names = ["rep", "links", "root"]

    def solve(t: pa.Table) -> pa.Table:
        """All pieces of a sorted table."""
        key = np.stack([t[k].to_numpy() for k in keys], axis=1)
        rep, copies, side = (t[k].to_numpy() for k in ("rep", "copies", "side"))
        vectors, filters = t["v"].combine_chunks(), t["filters"].combine_chunks()
        parts: list[tuple] = []
        for a, b in runs_of(t, keys):
            if b - a < 2 or key[a, 1] != key[a, 2] and side[a:b].min() == side[a:b].max():
                continue
            v = vectors.slice(a, b - a).flatten().to_numpy().astype(float).reshape(b - a, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            f = filters.slice(a, b - a)
            owner, ids = np.repeat(np.arange(b - a), f.value_lengths().to_numpy()), f.flatten().to_numpy()
            owner, ids = owner[ids < key[a, 0]], ids[ids < key[a, 0]]
            some, at, times = np.unique(ids, return_inverse=True, return_counts=True)
            place = np.cumsum(times > 1) - 1
            seen = np.zeros((b - a, int((times > 1).sum())), np.float32)
            both = times[at] > 1
            seen[owner[both], place[at[both]]] = 1
            links, root = compare(rep[a:b], copies[a:b], v / np.linalg.norm(v, axis=1, keepdims=True), side[a:b], seen, cosine)
            keep = (links > 0) | (root != rep[a:b])
            parts.append((rep[a:b][keep], links[keep], root[keep]))
        return pa.table([pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for i in range(3)], names=names)

    def run(batches):
        for t in whole_runs(batches, keys):
            yield from solve(t).to_batches()

    return rows.select(*keys, "rep", "copies", "side", "v", "filters").mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    reps = staged(distinct_vectors(vectors.select("vec_id", "embedding")), "vectors")
    coded = staged(with_filters(reps, reps.count()), "vector-filters")
    passed = coded.select("rep", F.explode("filters").alias("filter"))
    crowds = passed.groupBy("filter").agg(F.count("*").alias("n")).filter("n > 1")
    pieces = passed.join(crowds, "filter").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    pieces = pieces.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = pieces.select("rep", "filter", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"))
    links = staged(link_pieces(pieces.join(coded, "rep"), cosine), "vector-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(links.select("rep", "root")).withColumnRenamed("node", "rep")
    found = reps.join(counts, "rep", "left").join(roots, "rep", "left").select(
        "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).join(found, "v", "left")
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("component", "vec_id"))
    return rows.select(
        "vec_id", F.when(named, F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
