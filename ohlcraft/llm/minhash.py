"""Near-duplicate texts by improved consistent weighted sampling.

A text is a weighted set of shingles, five words each (all words, if fewer). A shingle weighs its count in the text times
the mean inverse document frequency of its words. Word frequencies serve because a shingle's own is 1 nearly everywhere but
in copies, where it would play down what shows them. They are counted over all documents in ``IDF_BUCKETS`` hashed
counters, a bound that does not grow with the vocabulary; words that share a counter share its count.

Consistent weighted sampling draws ``BANDS * ROWS`` (shingle, level) pairs per text such that two texts agree in a draw with
the probability of their weighted Jaccard similarity. Texts that agree in all draws of a band meet, and what meets is
verified by the weighted Jaccard similarity of whole texts. A text whose draws meet nobody else's is never read again.

Large meetings are cut into blocks. Every block is compared within itself and with the meeting's first text; who is not yet
connected to that one is then compared with all blocks. So a group of close copies costs time in proportion to its size, and
no link is lost for speed. Pairs are never written out, only who is connected to whom.

Equal texts are one text from the start. Nulls: a null text is an empty one; texts without words equal each other and
nothing else. A row with a null id gets its group's class like any other; a group of null ids alone has a number made of its
text's hash. Repeated rows are copies. An empty table gives an empty result. A very long text is read whole; its shingles are
drawn in pieces. Other columns may have any name; ``first_of_each`` returns them as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNTS, map_rows, packed_counts, release, runs_of, smallest_linked, staged, summed_counts, text_of, whole_runs
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 14
ROWS = 4
IDF_BUCKETS = 1 << 20
BLOCK = 256
SEED = 9
#: Random variates of a draw; a shingle's variates are picked by its hash.
_POOL = 1 << 16
_COLUMNS = 4096

_draws = np.random.default_rng(SEED)
_BYTE = _draws.integers(0, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _draws.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_PICK = _draws.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_R = _draws.gamma(2.0, 1.0, _POOL).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_LOG_C = np.log(_draws.gamma(2.0, 1.0, _POOL)).astype(np.float32)
_BETA = _draws.random(_POOL, np.float32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each run of bytes between blanks."""
    b = np.frombuffer(text.encode(), np.uint8)
    word = (b != 0x20) & ((b < 0x09) | (b > 0x0D))
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    lengths = np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = b[word]
    h = _mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _BYTE[place & 0xFFFF], first) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > len(_BYTE)).tolist():  # multipliers would come round again
        h[i] = int.from_bytes(hashlib.blake2b(letters[first[i] : first[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different shingles of a text, how often each occurs, and its inverse document frequency."""
    w = word_hashes(text)
    k = min(SHINGLE, len(w))
    if not k:
        return w, np.zeros(0, np.int64), np.zeros(0, np.float32)
    n = len(w) - k + 1
    rare = idf[(w >> np.uint64(40)).astype(np.int64) & (IDF_BUCKETS - 1)]
    h, weight = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    for i in range(k):  # always added in this order, so equal shingles weigh the same to the last bit
        h += w[i : i + n] * _PLACE[i]
        weight += rare[i : i + n]
    h, at, count = np.unique(_mix(h), return_index=True, return_counts=True)
    return h, count, weight[at] / np.float32(k)


def bands(text: str, idf: np.ndarray) -> np.ndarray:
    """A hash per band of the draws of a text; none for a text without words."""
    h, count, rare = shingles(text, idf)
    if not len(h):
        return np.zeros(0, np.int64)
    log_w = np.log(count.astype(np.float32) * rare)
    best = np.full(len(_PICK), np.inf, np.float32)
    drawn = np.zeros(len(_PICK), np.uint64)
    for i in range(0, len(h), 512):
        x, lw = h[i : i + 512], log_w[i : i + 512]
        pick = ((x[None, :] * _PICK[:, None]) >> np.uint64(48)).astype(np.int64)
        level = np.floor(lw[None, :] * _INVERSE_R[pick] + _BETA[pick])
        a = _LOG_C[pick] - _R[pick] * (level - _BETA[pick] + np.float32(1))
        at = a.argmin(axis=1)
        rows = np.arange(len(_PICK))
        better = a[rows, at] < best
        best[better] = a[rows, at][better]
        drawn[better] = (x[at] + level[rows, at].astype(np.int64).view(np.uint64) * _BYTE[0])[better]
    out = np.full(BANDS, np.uint64(SEED))
    for row in _mix(drawn).reshape(BANDS, ROWS).T:
        out = _mix(out * _PLACE[0] + row)
    return out.view(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + log((1 + documents) / (1 + documents with the word)) per hashed counter, over all documents."""
    segment = 1 << 14
    rows = docs.select(text_of().alias("text"))

    def count(batches):
        total = np.zeros(IDF_BUCKETS + segment, np.int64)  # the number of documents comes last
        for batch in batches:
            for text in batch.column(0):
                total[np.unique((word_hashes(text.as_py()) >> np.uint64(40)).astype(np.int64) & (IDF_BUCKETS - 1))] += 1
            total[IDF_BUCKETS] += batch.num_rows
        if total[IDF_BUCKETS]:
            yield packed_counts(total, segment)
        batch = None
        release()

    held = summed_counts(rows.mapInArrow(count, COUNTS), IDF_BUCKETS + 1, segment, rows.rdd.getNumPartitions())
    return (1 + np.log((1 + held[-1]) / (1 + held[:-1]))).astype(np.float32)


def verify(texts: list[str], idf: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the weighted Jaccard similarity of each two texts is at least ``similarity``."""
    n, parts = len(texts), []
    for i, text in enumerate(texts):
        h, count, rare = shingles(text, idf)
        h = np.repeat(h, count)  # the second of a shingle is an element of its own, and so on
        level = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        parts.append((h + level.astype(np.uint64) * _BYTE[1], np.repeat(rare, count).astype(float), np.full(len(h), i)))
    h, rare, owner = (np.concatenate(p) for p in zip(*parts, strict=True))
    total = np.bincount(owner, rare, n)
    _, first, at, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    owner, column, weight = owner[shared], column[at[shared]], rare[first[times > 1]]
    common = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, len(weight), _COLUMNS):
        a, b = np.searchsorted(column, [c, c + _COLUMNS])
        m = np.zeros((n, min(_COLUMNS, len(weight) - c)))
        m[owner[a:b], column[a:b] - c] = 1
        common += (m * weight[c : c + _COLUMNS]) @ m.T
    union = total[:, None] + total[None, :] - common
    return (common >= similarity * union - 1e-9) & (union > 0)


def linked(pieces: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Verify who meets in a piece: node, and the smallest node that it is connected to."""
    keys = ["band", "hash", "one", "two"]
    rows = texts.join(pieces, "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        for t in whole_runs(batches, keys):
            node = t["node"].to_numpy()
            out: list[tuple] = []
            for a, b in runs_of(t, keys):
                own, at = np.unique(node[a:b], return_index=True)
                if len(own) > 1:
                    root = own[smallest_linked(verify(t["text"].take(at + a).to_pylist(), idf.value, similarity))]
                    out.append((own[root != own], root[root != own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in (0, 1)], names=["node", "root"])
        t = None
        release()

    return rows.select(*keys, "node", "text").mapInArrow(run, "node long, root long")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, text_key2 and class_id (the smallest doc_id of its class) of every row."""
    spark = docs.sparkSession
    text = text_of()
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(SEED), text).alias("text_key2"), text.alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([bands(t, idf.value) for t in batch.column(3).to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=[*batch.schema.names[:3], "bands"])

        return step

    signed = staged(map_rows(rows, make, "doc_id long, text_key long, text_key2 long, bands array<long>"), "minhash-bands")
    # of equal texts the one with the smallest id goes on
    number = F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1) - F.shiftrightunsigned("text_key", 2))
    same = staged(signed.groupBy("text_key", "text_key2").agg(number.alias("node"), F.first("bands").alias("bands")), "minhash-texts")
    met = same.select("node", F.posexplode("bands").alias("band", "hash"))
    meetings = met.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("n > 1")
    # bands that bring the same texts together are one meeting
    meetings = meetings.groupBy("n", "leader", "who").agg(F.min(F.struct("band", "hash")).alias("m")).select("m.*", "n", "leader", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    meetings = staged(meetings, "minhash-meetings")
    members = staged(met.join(meetings, ["band", "hash"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "minhash-members")
    none = F.lit(0).cast("long")
    pieces = members.select("band", "hash", F.col("block").alias("one"), none.alias("two"), "node").unionByName(
        meetings.filter("blocks > 1").select("band", "hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("one"), none.alias("two"), F.col("leader").alias("node")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64(text), 2)).alias("node"), text.alias("text"))
    # pieces grow with the corpus, so this join is a merge join at every size
    links = staged(linked(pieces.hint("merge"), texts, idf, similarity), "minhash-links")
    # meetings of several blocks: who isn't connected to the first text yet meets everybody else
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        now = components(links).withColumnRenamed("node", "of")
        side = now.select(F.col("of").alias("leader"), F.col("component").alias("lead"))
        large = large.join(now.withColumnRenamed("of", "node"), "node", "left").join(side, "leader", "left")
        large = large.withColumn("apart", F.coalesce("component", "node") != F.coalesce("lead", "leader"))
        apart = large.filter("apart").groupBy("band", "hash").agg(F.ceil(F.count("*") / BLOCK).alias("groups"))
        large = staged(large.join(apart, ["band", "hash"]).withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups"))), "minhash-apart")
        up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        again = large.filter("apart").select("band", "hash", F.col("group").alias("one"), up_to("blocks").alias("two"), "node").unionByName(
            large.select("band", "hash", up_to("groups").alias("one"), F.col("block").alias("two"), "node")).distinct()
        links = links.unionByName(linked(again, texts, idf, similarity))
    found = same.select("text_key", "text_key2", "node").join(components(links), "node", "left")
    return signed.select("doc_id", "text_key", "text_key2").join(
        found.select("text_key", "text_key2", F.coalesce("component", "node").alias("class_id")), ["text_key", "text_key2"])


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document with the smallest id of each class, with its own columns; of repeated rows one stays."""
    own, last = docs.columns, F.lit((1 << 63) - 1)
    named = lambda c: F.coalesce(c.cast("long"), last)
    found = classes(docs, similarity).withColumn("doc", named(F.col("doc_id"))).filter((F.col("doc") == F.col("class_id")) | F.col("doc_id").isNull())
    keep = found.groupBy("class_id").agg(F.min(F.struct("doc", "text_key")).alias("k")).select(F.col("k.doc").alias("__near_doc"), F.col("k.text_key").alias("__near_text"))
    rows = docs.withColumn("__near_doc", named(F.col("doc_id"))).withColumn("__near_text", F.xxhash64(text_of()))
    # the join deals rows out by the same keys as the removal of repeated rows, so texts move once
    return rows.join(keep, ["__near_doc", "__near_text"], "left_semi").dropDuplicates(["__near_doc", "__near_text"]).select(*own)


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    found = classes(docs, similarity)
    sizes = found.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return found.join(sizes, "class_id").select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))
