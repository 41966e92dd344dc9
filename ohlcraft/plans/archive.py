"""Smaller operators kept from older tooling: text chunks, vector search, risk rules, reports."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col


def text_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", limit: int = 600) -> DataFrame:
    """Sections at level-one and level-two headings, packed by paragraph up to ``limit`` characters.

    One row per document goes in and its chunks come out by array functions: texts are never cut.
    """
    clean = F.regexp_replace(text, "\r\n?", "\n")
    parts = docs.select(doc, c(source).alias("source"), F.posexplode(F.split(clean, "(?m)^(?=#{1,2} )")).alias("sec", "body"))
    first = F.split_part("body", F.lit("\n"), F.lit(1))
    heading = F.when(first.rlike("^#{1,2} "), F.trim(F.regexp_replace(first, "^#+", ""))).otherwise(c("source"))
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    parts = parts.select(doc, "source", "sec", heading.alias("heading"), body.alias("body")).filter("body != ''")

    def pack(state: Column, para: Column) -> Column:
        size = F.length(para) + 2
        full = (state["n"] + size > limit) & (state["n"] > 0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["buf"]))).otherwise(state["done"]).alias("done"),
            F.when(full | (state["n"] == 0), para).otherwise(F.concat(state["buf"], F.lit("\n\n"), para)).alias("buf"),
            F.when(full, size).otherwise(state["n"] + size).cast("int").alias("n"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("n"))
    packed = F.aggregate(F.split("body", "\n\n"), start, pack, lambda s: F.concat(s["done"], F.array(s["buf"])))
    pieces = F.when(F.length("body") <= limit, F.array("body")).otherwise(packed)
    out = parts.select(doc, "source", "sec", "heading", F.posexplode(pieces).alias("piece", "text"))
    # ordinals inside a document follow from how many pieces its earlier sections have
    n = F.row_number().over(Window.partitionBy(doc).orderBy("sec", "piece")) - 1
    out = out.withColumn("n", n)
    key = F.concat_ws(":", c("source"), c("heading"), c("n").cast("string"), F.substring("text", 1, 50))
    return out.select(doc, "n", "heading", "text", F.substring(F.sha2(key, 256), 1, 16).alias("chunk_id"))


#: A block of queries meets a block of points in one group.
MAX_QUERIES = 10_000
POINTS = 50_000
#: Fewer points than ``POINTS`` are still dealt out to this many groups.
LEAST_GROUPS, FEW_POINTS = 32, 1_000
#: Products of blocks differ from sums in order by far less.
MARGIN = 1e-9


def cosine_top_k(points: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", pid: str = "vec_id", qid: str = "q_id") -> DataFrame:
    """Exact top-k by cosine: every query against every point, so the work is their product.

    Blocks of queries and of points meet by a shuffle and are multiplied as matrices; what may be among the k best is scored
    again in double precision, coordinate by coordinate, and equal scores go by id. Vectors that are null, empty or not
    finite, rows without an id, ids that are no integers and vectors of unequal length are compared pair by pair.
    """
    v = F.col("_v")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # lengths whose products neither vanish nor overflow
    safe = F.when(finite, (size == 0) | size.between(1e-100, 1e100))

    def sides(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int, int, set]:
        even = c(key).isNotNull() & F.coalesce((F.size("_v") > 0) & safe, F.lit(False))
        df = df.withColumn("_v", c(vec).cast("array<double>")).withColumn("_even", even)
        n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if("_even").alias("even"), F.min(F.when(c("_even"), F.size("_v"))).alias("a"), F.max(F.when(c("_even"), F.size("_v"))).alias("z")).first()
        return df.filter("_even").drop("_v", "_even"), df.filter(~c("_even")).drop("_v", "_even"), n.even, n.n - n.even, {n.a, n.z} - {None}

    whole = all(df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte") for df, key in ((points, pid), (queries, qid)))
    if not whole:
        return _ranked(_pairs(points, queries, k, vec, pid, qid), k, pid, qid)
    p, odd_p, n_p, n_odd_p, lengths = sides(points, pid)
    q, odd_q, n_q, n_odd_q, others = sides(queries, qid)
    if len(lengths | others) != 1 or not n_p or not n_q:
        return _ranked(_pairs(points, queries, k, vec, pid, qid), k, pid, qid)
    found = [_blocks(p, q, n_p, n_q, k, vec, pid, qid)]
    if n_odd_p:
        found.append(_pairs(odd_p, queries, k, vec, pid, qid))
    if n_odd_q:
        found.append(_pairs(p, odd_q, k, vec, pid, qid))
    return _ranked(reduce(DataFrame.unionByName, found), k, pid, qid)


def _ranked(scored: DataFrame, k: int, pid: str, qid: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(qid).orderBy(c("score").desc(), pid))
    return scored.withColumn("rank", best).filter(c("rank") <= k).select(qid, "rank", pid, "score")


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(x, x))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the coordinates."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points (``x``, ``ids``) of each query (``y``): query row, id and score."""
    nx, ny = _lengths(x), _lengths(y)
    ux, uy = x / np.where(nx > 0, nx, 1)[:, None], y / np.where(ny > 0, ny, 1)[:, None]
    parts = []
    for a in range(0, len(y), 1024):
        own, at, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        least = np.full(min(1024, len(y) - a), -np.inf)
        for b in range(0, len(x), 4096):
            near = uy[a : a + 1024] @ ux[b : b + 4096].T
            if near.shape[1] >= k:
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
            i, j = np.nonzero(near >= least[:, None] - MARGIN)
            for s in range(0, len(i), 65_536):
                m, n = i[s : s + 65_536], j[s : s + 65_536] + b
                length = nx[n] * ny[a + m]
                got = np.where(length > 0, _dots(x[n], y[a + m]) / np.where(length > 0, length, 1), 0.0)
                own, at, score = np.concatenate([own, m]), np.concatenate([at, n]), np.concatenate([score, got])
                order = np.lexsort((ids[at], -score, own))
                own, at, score = own[order], at[order], score[order]
                keep = np.arange(len(own)) - np.searchsorted(own, own) < k
                own, at, score = own[keep], at[keep], score[keep]
            last = np.searchsorted(own, np.arange(len(least)), side="right") - 1
            full = np.bincount(own, minlength=len(least)) >= k
            least[full] = np.maximum(least[full], score[last[full]])
        parts.append((own + a, ids[at], score))
    return tuple(np.concatenate([p[n] for p in parts]) for n in range(3))


def _blocks(points: DataFrame, queries: DataFrame, n_points: int, n_queries: int, k: int, vec: str, pid: str, qid: str) -> DataFrame:
    """The k best of every block of points, for queries and points of one length without odd values."""
    b, j = -(-n_queries // MAX_QUERIES), max(-(-n_points // POINTS), min(LEAST_GROUPS, -(-n_points // FEW_POINTS)))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        df = df.select(c(key).cast("long").alias("_id"), c(vec).alias("_v"), F.pmod(F.xxhash64(key), F.lit(n)).alias(own))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).repartition(b * j, "_b", "_j")

    def solve(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return schema.empty_table()
        x, y = (t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1) for t in (p, q))
        row, best, score = _best(x, p["_id"].to_numpy(), y, k)
        return pa.table([q["_id"].to_numpy()[row], best, score], schema=schema)

    schema = pa.schema([(qid, pa.int64()), (pid, pa.int64()), ("score", pa.float64())])
    left, right = dealt(points, pid, "_j", j, "_b", b), dealt(queries, qid, "_b", b, "_j", j)
    found = left.groupBy("_b", "_j").cogroup(right.groupBy("_b", "_j")).applyInArrow(solve, f"`{qid}` long, `{pid}` long, score double")
    return found.withColumns({qid: c(qid).cast(queries.schema[qid].dataType), pid: c(pid).cast(points.schema[pid].dataType)})


def _pairs(points: DataFrame, queries: DataFrame, k: int, vec: str, pid: str, qid: str) -> DataFrame:
    """Pair by pair, the queries broadcast in blocks; each partition keeps its own k best per query."""
    blocks = -(-queries.count() // MAX_QUERIES)
    block = F.pmod(F.xxhash64(qid), F.lit(max(blocks, 1)))
    parts = [_top_k_block(points, queries if blocks < 2 else queries.filter(block == i), k, vec, pid, qid) for i in range(max(blocks, 1))]
    return reduce(DataFrame.unionByName, parts)


def _top_k_block(points: DataFrame, queries: DataFrame, k: int, vec: str, pid: str, qid: str) -> DataFrame:
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    q = queries.select(c(qid), c(vec).cast("array<double>").alias("_q")).withColumn("_qn", norm(c("_q")))
    p = points.withColumn("_v", c(vec).cast("array<double>")).withColumns({"_vn": norm(c("_v")), "_part": F.spark_partition_id()})
    dot = F.aggregate(F.zip_with("_v", "_q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    j = p.crossJoin(F.broadcast(q)).withColumn("score", F.when(c("_vn") * c("_qn") > 0, dot / F.nullif(c("_vn") * c("_qn"), F.lit(0.0))).otherwise(0.0))
    best = F.row_number().over(Window.partitionBy("_part", qid).orderBy(c("score").desc(), pid))
    return j.withColumn("rank", best).filter(c("rank") <= k).select(qid, pid, "score")


def latest_by_id(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: the newest version of every id."""
    rest = [x for x in rows.columns if x != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_v")).select(key, *[c(f"_v.{x}").alias(x) for x in rest])


def performance(trades: DataFrame, by: list[str], pnl: str = "pnl") -> DataFrame:
    gain, loss = F.sum(F.when(c(pnl) > 0, c(pnl)).otherwise(0.0)), F.sum(F.when(c(pnl) < 0, -c(pnl)).otherwise(0.0))
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
                                   F.avg((c(pnl) > 0).cast("double")).alias("win_rate"), F.avg("bars_held").alias("avg_hold_bars"), F.sum(pnl).alias("total_pnl"))


def baseline_gate(sharpe: Column, pf: Column, best_sharpe: Column, best_pf: Column, min_pct: float = 5.0) -> Column:
    up_s = F.when(best_sharpe != 0, (sharpe - best_sharpe) / F.abs(F.nullif(best_sharpe, F.lit(0.0))) * 100).otherwise(0.0)
    up_p = F.when(best_pf != 0, (pf - best_pf) / F.abs(F.nullif(best_pf, F.lit(0.0))) * 100).otherwise(0.0)
    return F.when((up_s > min_pct) | (up_p > min_pct), "pass").when((sharpe >= best_sharpe) & (pf >= best_pf), "simplify").otherwise("fail")


def stop_required(min_sl: float = 0.0, min_tp: float = 0.0) -> Column:
    """Reason a signal is refused for its stop or target, NULL when it may pass."""
    px = F.nullif(c("entry_price"), F.lit(0.0))
    sl, tp = F.abs(c("entry_price") - c("sl")) / px, F.abs(c("entry_price") - c("tp")) / px
    return F.when(c("sl").isNull() | c("tp").isNull(), "no_stop_or_target").when(sl < min_sl, "stop_too_near").when(
        tp < min_tp, "target_too_near")


def position_size(capital: Column, pct: Column, max_units: Column, price: Column, wanted: Column) -> Column:
    """Units allowed by capital and cap; NULL below one billionth."""
    size = F.least(capital * pct / F.nullif(price, F.lit(0.0)), F.coalesce(max_units, F.lit(float("inf"))), wanted)
    return F.when((capital > 0) & (size > 1e-9), size)


def class_accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(actual).agg(F.count(F.lit(1)).alias("n"), F.avg((c(actual) == c(predicted)).cast("double")).alias("accuracy"))


def random_walk_bars(spark: SparkSession, symbols: int, n: int, seed: int = 7, drift: float = 0.0, vol: float = 0.01) -> DataFrame:
    """Geometric random-walk bars for demonstrations: generated in parallel, one stream per bar ordinal."""
    base = spark.range(symbols * n).select((c("id") % symbols).cast("string").alias("symbol"), F.floor(c("id") / symbols).alias("idx"))
    return base.withColumn("ret", drift + vol * F.randn(seed)).withColumn("ts", c("idx") * 60_000)
