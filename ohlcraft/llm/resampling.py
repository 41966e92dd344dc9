"""Importance resampling towards a target distribution, over hashed word n-grams.

Every run of one to ``GRAMS`` words is a feature; its CRC-32 modulo ``BUCKETS`` is its bucket. A bucket's gain is the log
ratio of its smoothed share in the target and in the corpus, a document's weight the sum of its gains. Gumbel noise from
the document's id turns the highest scores into a draw without replacement.

Features are hashed in matrices: the distinct features of a piece of text are grouped by their length in bytes, each group
is a two-dimensional ``uint8`` array, and all CRCs of a group advance together, one column of bytes at a time; buckets are
then scattered back to the places of the features. Groups of features beyond ``LONG`` bytes (rare) are hashed one by one.

A document's buckets are written once (two bytes each) and read for the counts and for the weights. Counts are added up per
task and then per bucket: the gains, ``BUCKETS`` numbers whatever the corpus, are the only thing that is broadcast. Ranks
come from a range sort of ids and scores; no task sees more than a range.

Nulls: a null text has no features and weight 0; a null doc_id draws its noise from an empty id and precedes others among
ties. Long texts are hashed whole, in pieces. Repeated rows count and are ranked each. Only ``doc_id`` and ``text`` are read, so that
other columns can have any name; ``resample`` returns them untouched. Empty tables give no rows, an empty target negative gains only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ranked, staged, text_of

GRAMS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Words hashed at a time, bytes of texts taken together, bytes of a matrix.
PIECE = 1 << 18
TOGETHER = 1 << 22
MATRIX = 1 << 18
#: Features of more bytes are hashed one by one.
LONG = 256


def _crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 (reflected polynomial EDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


CRC = _crc_table()
_byte = np.arange(256)
#: ASCII capitals become small letters.
SMALL = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words: digits, letters a to z, and everything beyond ASCII.
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def crc32_matrix(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """CRC-32 of the ``length`` bytes from each start, all rows advancing one column at a time."""
    out = np.empty(len(start), np.uint32)
    rows = max(1, MATRIX // max(1, length))
    for a in range(0, len(start), rows):
        matrix = data[start[a : a + rows][None, :] + np.arange(length)[:, None]]  # one row per column of bytes
        crc = np.full(matrix.shape[1], 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[a : a + rows] = ~crc
    return out


def crc32_all(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ragged pieces of a buffer, bucketed by length."""
    out = np.empty(len(start), np.uint32)
    short = np.minimum(length, LONG + 1).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    sizes = short[order]
    cuts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True]) if len(order) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some, n = order[a:b], int(sizes[a])
        if n > LONG:
            out[some] = [zlib.crc32(data[s : s + k]) for s, k in zip(start[some].tolist(), length[some].tolist(), strict=True)]
        else:
            out[some] = crc32_matrix(data, start[some], n)
    return out


def _distinct(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value, and the first place of each number."""
    ids = values.dictionary_encode().indices.to_numpy()
    first = np.empty(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    return ids.astype(np.int64), first


def piece_buckets(lowered: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, keep: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Owner and bucket of each feature that starts at one of the first ``keep`` words of a piece, per number of words."""
    size = end - start
    inside = lowered[start[0] : end[-1]]
    letters = inside[IS_WORD[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(letters)])
    at = np.r_[0, np.cumsum(size + 1)]
    line = np.full(at[-1], 32, np.uint8)  # the words with one space after each: every feature is a piece of it
    line[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    ids, first = _distinct(words)
    vocabulary, runs = len(first), ids
    found, firsts = [], []
    for n in range(1, GRAMS + 1):
        if n > 1:
            runs, first = _distinct(pa.array(runs[:-1] * vocabulary + ids[n - 1 :]))
        found.append(runs)
        firsts.append(first)
    where = np.concatenate(firsts)
    words_of = np.repeat(np.arange(1, GRAMS + 1), [len(f) for f in firsts])
    bucket = (crc32_all(line, at[where], at[where + words_of] - 1 - at[where]) % buckets).astype(np.uint16)
    out, base = [], 0
    for n, (ids_n, first) in enumerate(zip(found, firsts, strict=True), 1):
        same = owner[: len(ids_n)] == owner[n - 1 :]
        same[keep:] = False
        out.append((owner[: len(ids_n)][same], bucket[base : base + len(first)][ids_n[same]]))
        base += len(first)
    return out


def text_buckets(data: np.ndarray, edges: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, list[bytes]]:
    """Words, and buckets of all features (unsigned 16-bit, little-endian), of each text between two edges of a buffer."""
    lowered = SMALL[data]
    word = np.r_[False, IS_WORD[lowered], False]
    cut = np.zeros(len(lowered) + 1, bool)
    cut[edges] = True
    inside = word[1:-1]
    start = np.flatnonzero(inside & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(inside & (~word[2:] | cut[1:])) + 1
    owner = np.searchsorted(edges, start, side="right") - 1
    n_texts = len(edges) - 1
    parts: list[list[bytes]] = [[] for _ in range(n_texts)]
    for a in range(0, len(start), PIECE):
        b = min(len(start), a + PIECE + GRAMS - 1)
        for of, bucket in piece_buckets(lowered, start[a:b], end[a:b], owner[a:b], PIECE, buckets):
            some = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else []
            for x, y in zip(some[:-1], some[1:], strict=True):
                parts[of[x]].append(bucket[x:y].astype("<u2").tobytes())
    return np.bincount(owner, minlength=n_texts)[:n_texts], [b"".join(p) for p in parts]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``TOGETHER`` bytes; a longer text is alone."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + TOGETHER, side="right")) - 1)
        yield a, b
        a = b


def hashed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of each text (see :func:`text_buckets`)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are kept in 16 bits")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, data = _buffers(batch.column(1))
            words, found = [], []
            for a, b in _groups(at):
                n, f = text_buckets(data[at[a] : at[b]], at[a : b + 1] - at[a], buckets)
                words.append(n)
                found += f
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(words).astype(np.int64)), pa.array([len(f) // 2 for f in found], pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets"])

        return step

    return map_rows(texts, make, "doc_id long, n_words long, n_features long, buckets binary")


def totals(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Features of each bucket that has any, in all texts: added up per batch in the task, then by bucket."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            at, data = _buffers(batch.column(0))
            count = np.bincount(data[at[0] : at[-1]].view("<u2"), minlength=buckets)
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64())], names=["bucket", "features"])

        return step

    return map_rows(features.select("buckets"), make, "bucket int, features long").groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket; one number per bucket comes to the driver."""
    both = totals(corpus, buckets).withColumn("of", F.lit("s")).unionByName(totals(target, buckets).withColumn("of", F.lit("t")))
    count = {"s": np.zeros(buckets), "t": np.zeros(buckets)}
    for r in both.collect():
        count[r.of][r.bucket] = r.features
    s, t = count["s"], count["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the sum of the gains of the text's features."""
    shared = features.sparkSession.sparkContext.broadcast(gain)

    def make():
        of = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, data = _buffers(batch.column(3))
            held = np.r_[0, np.cumsum(of[data[at[0] : at[-1]].view("<u2")])]
            edge = (at - at[0]) // 2
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held[edge[1:]] - held[edge[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

        return step

    return map_rows(features, make, "doc_id long, n_words long, n_features long, weight long")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with its features, weight, score, and its rank if it is drawn.

    Of the documents with ``min_words`` words or more, ``percent`` of a hundred are drawn.
    """
    corpus = staged(hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), buckets), "features")
    aim = staged(hashed(target.select(F.lit(None).cast("long").alias("doc_id"), text_of().alias("text")), buckets), "features")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weighted(corpus, gains(corpus, aim, buckets)).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = staged(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") < min_words).alias("short"), (-F.col("score")).alias("down")), "scores")
    n = percent * scored.filter("not short").count() // 100
    out = ranked(scored, [], ["short", "down", "doc_id", "n_features"], "place", "rows")
    return out.select("doc_id", "n_features", "weight", "score", F.when(~F.col("short") & (F.col("place") < n), F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents drawn, with all their columns. Documents that share a drawn id come along, as ids stand for documents."""
    drawn = draw(docs, target, percent, min_words, buckets, seed).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
