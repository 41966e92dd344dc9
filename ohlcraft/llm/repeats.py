"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` consecutive words; a word goes if a window that covers it also starts in a document with a smaller id.

1. Every window has one *phrase*: of its runs of ``PHRASE`` words the one with the smallest hash (the last of equals), so equal
   windows have equal phrases at equal places. A scan lists each text's phrases, about one for twenty words.
2. A phrase that different texts share is recurring. Texts that equal one of a smaller id need no search: all their windows
   recur.
3. Documents meet the recurring phrases that they hold. Each block of documents compiles its phrases into an Aho-Corasick
   automaton, a shard that no other block needs, and its documents stream through it; the occurrences give the places of the phrases,
   word by word.
4. Windows whose phrase occurs are hashed. A block sends each different window once, with the smallest id that it has
   for it, to the bucket of its hash; the bucket answers each block with one bit per window: whether a smaller id exists. A
   passage that a third of all documents share is thus one entry per block.
5. Blocks mark the words of the windows found and write the rest.

Documents without a recurring phrase are done in step 3. Nulls: a null text has no words; a null id counts as larger than
all others. Repeated rows have equal ids, so neither removes words of the other. Empty texts and tables need no special case. Very
long texts are hashed and searched whole; a word beyond 65,536 bytes has a hash of its own kind. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, staged, text_of
from .minhash import _mix, word_hashes

WINDOW = 50
PHRASE = 8
#: Documents with recurring phrases in a block.
BLOCK_DOCS = 512
#: Different windows in a bucket, about.
BUCKET_WINDOWS = 500_000
WORD = re.compile("[^\x20\x09-\x0d]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size``: differences of running sums of ``h[i] * odd ** i``, brought back to power 0."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(h) - 1, _ODD)], dtype=np.uint64)
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(h) - size, np.uint64(pow(int(_ODD), -1, 1 << 64)))], dtype=np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(h * power, dtype=np.uint64)]
    return _mix((total[size:] - total[:-size]) * inverse)


def window_phrases(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``PHRASE`` words, and for each window the place of its phrase."""
    runs = _rolled(words, PHRASE)
    if len(words) < WINDOW:
        return runs, np.zeros(0, np.int64)
    low = (1 << 24) - 1
    place = np.arange(len(runs), dtype=np.uint64)
    now = (runs & ~np.uint64(low)) | (np.uint64(low) - (place & np.uint64(low)))  # the last of equal hashes is the smallest
    span, reach = WINDOW - PHRASE + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        now = np.minimum(now[: len(now) - step], now[step:])
        reach += step
    start = np.arange(len(now), dtype=np.uint64)
    back = (np.uint64(low) - (now & np.uint64(low))) - (start & np.uint64(low))
    return runs, (start + (back & np.uint64(low))).astype(np.int64)


def text_phrases(text: str) -> np.ndarray:
    """Different phrases of a text's windows."""
    runs, at = window_phrases(word_hashes(text))
    return np.unique(runs[np.unique(at)]).view(np.int64) if len(at) else np.zeros(0, np.int64)


def compiled(texts: list[list[str]], hashes: list[np.ndarray], wanted: list[np.ndarray]) -> ahocorasick.Automaton:
    """The automaton of a block: the phrases of its documents that recur, as words between blanks."""
    out = ahocorasick.Automaton()
    for words, runs, want in zip(texts, hashes, wanted, strict=True):
        _, first = np.unique(runs, return_index=True)
        for i in first[np.isin(runs[first], want)].tolist():
            out.add_word(f" {' '.join(words[i : i + PHRASE])} ", 1)
    out.make_automaton()
    return out


def occurrences(words: list[str], automaton: ahocorasick.Automaton) -> np.ndarray:
    """Words at which a phrase of the automaton starts."""
    found = np.zeros(max(0, len(words) - PHRASE + 1), bool)
    if len(found) and len(automaton):
        text = f" {' '.join(words)} "
        ends = np.array([end for end, _ in automaton.iter(text)], np.int64)
        blanks = np.cumsum([len(w) + 1 for w in words])  # of the blank after each word
        found[np.searchsorted(blanks, ends) - PHRASE + 1] = True
    return found


def _kept(words: list[str], remove: np.ndarray) -> tuple[int, str]:
    left = [w for w, r in zip(words, remove.tolist(), strict=True) if not r] if remove.any() else words
    return len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()


_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                   ("block", pa.int64()), ("n_windows", pa.int64()), ("data", pa.binary()), ("windows", pa.binary()), ("owners", pa.binary())])
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, block long, n_windows long, data binary, windows binary, owners binary"


def _pack(*parts: bytes) -> bytes:
    return zlib.compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts), 1)


def _unpack(data: bytes) -> list[bytes]:
    data, at, out = zlib.decompress(data), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _block(number: int, ids: list[int], texts: list[str], wanted: list[np.ndarray]) -> dict:
    """Steps 3 and 4 for a block of documents."""
    words = [WORD.findall(t) for t in texts]
    hashes = [word_hashes(t) for t in texts]
    phrased = [window_phrases(h) for h in hashes]
    automaton = compiled(words, [runs for runs, _ in phrased], wanted)
    starts, windows, owners = [], [], []
    for doc, w, h, (runs, at) in zip(ids, words, hashes, phrased, strict=True):
        mine = np.flatnonzero(occurrences(w, automaton)[at]) if len(at) else np.zeros(0, np.int64)
        starts.append(mine.astype(np.int32))
        windows.append(_mix(_rolled(h, WINDOW)[mine] + runs[at[mine]]) if len(mine) else np.zeros(0, np.uint64))
        owners.append(np.full(len(mine), doc, np.int64))
    window, owner = np.concatenate(windows), np.concatenate(owners)
    _, first, at = np.unique(window, return_index=True, return_inverse=True)
    order = np.argsort(first)  # numbered in order of first sight, which packs well
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    index = rank[at]
    least = np.full(len(order), _LAST, np.int64)
    np.minimum.at(least, index, owner)
    counts = np.array([len(s) for s in starts], np.int64)
    steps = np.diff(index, prepend=0).astype(np.int32)
    return {"block": number, "n_windows": len(order), "windows": window[first[order]].tobytes(), "owners": least.tobytes(),
            "data": _pack(np.array(ids, np.int64).tobytes(), counts.tobytes(), np.diff(np.concatenate(starts), prepend=np.int32(0)).tobytes(), steps.tobytes(),
                          *(t.encode() for t in texts))}


def _finish(data: bytes, smaller: np.ndarray, owners: np.ndarray) -> list[tuple]:
    """Step 5: rows of a block's documents. ``smaller``: whether another block has a smaller id for each window."""
    ids, counts, starts, steps, *texts = _unpack(data)
    ids, counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
    starts, index = np.cumsum(np.frombuffer(starts, np.int32), dtype=np.int64), np.cumsum(np.frombuffer(steps, np.int32), dtype=np.int64)
    out, at = [], 0
    for doc, n, text in zip(ids.tolist(), counts.tolist(), texts, strict=True):
        words, mine = WORD.findall(text.decode()), index[at : at + n]
        gone = starts[at : at + n][smaller[mine] | (owners[mine] < doc)]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        out.append((None if doc == _LAST else doc, len(words), *_kept(words, np.cumsum(cover)[:-1] > 0)))
        at += n
    return out


def recurring(listed: DataFrame) -> DataFrame:
    """doc, text_key and the recurring phrases of each text's first document; and the documents that are copies."""
    key = ["text_key", "text_key2"]
    first = staged(listed.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("most"), F.first("phrases").alias("phrases")), "repeat-texts")
    each = first.filter(F.size("phrases") > 0).select("first", "text_key", F.explode("phrases").alias("phrase"))
    shared = each.groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    wanted = each.join(shared, "phrase").groupBy(F.col("first").alias("doc"), "text_key").agg(F.collect_list("phrase").alias("phrases"))
    copies = listed.join(first.filter("most > first").select(*key, "first"), key).filter("doc > first").select("doc", "text_key").distinct()
    return wanted.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("phrases", F.expr("cast(array() as array<long>)")).withColumn("copy", F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    text = text_of()
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(5), text).alias("text_key2"), text.alias("text"))

    def list_phrases():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([text_phrases(t) for t in batch.column(3).to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=[*batch.schema.names[:3], "phrases"])

        return step

    listed = staged(map_rows(own, list_phrases, "doc long, text_key long, text_key2 long, phrases array<long>"), "repeat-phrases")
    joined = own.drop("text_key2").join(recurring(listed), ["doc", "text_key"], "left").select("doc", "text", "phrases", F.coalesce("copy", F.lit(False)).alias("copy"))

    def search(batches):
        number, ids, texts, wanted = TaskContext.get().partitionId() << 32, [], [], []

        def table(done: list[tuple], blocks: list[dict]) -> pa.Table:
            rows = [dict(zip(_DONE.names[:4], d, strict=True)) for d in done] + blocks
            return pa.Table.from_pylist(rows, schema=_DONE)

        for batch in batches:
            done, blocks = [], []
            for doc, t, want, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if want:
                    ids.append(doc)
                    texts.append(t)
                    wanted.append(np.array(want, np.int64).view(np.uint64))
                    if len(ids) == BLOCK_DOCS:
                        blocks.append(_block(number, ids, texts, wanted))
                        number, ids, texts, wanted = number + 1, [], [], []
                else:
                    words = WORD.findall(t)
                    done.append((None if doc == _LAST else doc, len(words), *_kept(words, np.full(len(words), copy and len(words) >= WINDOW))))
            yield from table(done, blocks).to_batches()
        if ids:
            yield from table([], [_block(number, ids, texts, wanted)]).to_batches()

    searched = staged(joined.mapInArrow(search, _SCHEMA), "repeat-blocks")
    blocks = searched.filter(F.col("block").isNotNull())
    buckets = max(1, -(-(blocks.agg(F.sum("n_windows")).first()[0] or 0) // BUCKET_WINDOWS))

    def send():
        def step(batch: pa.RecordBatch) -> pa.Table:
            out: dict[str, list] = {"bucket": [], "block": [], "windows": [], "owners": []}
            for block, w, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w, o = np.frombuffer(w, np.uint64), np.frombuffer(o, np.int64)
                to = (w % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                for b, part in zip(*_split(to[order], order), strict=True):
                    for k, v in zip(out, (b, block, w[part].tobytes(), o[part].tobytes()), strict=True):
                        out[k].append(v)
            return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "block": pa.array(out["block"], pa.int64()), "windows": pa.array(out["windows"], pa.binary()), "owners": pa.array(out["owners"], pa.binary())})

        return step

    def answer(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["windows"]]
        owner = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t["owners"]])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        least = np.full(int(at.max()) + 1, _LAST, np.int64)
        np.minimum.at(least, at, owner)
        bits = np.split(least[at] < owner, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"bucket": t["bucket"], "block": t["block"], "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    sent = map_rows(blocks.select("block", "windows", "owners"), send, "bucket long, block long, windows binary, owners binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "bucket long, block long, bits binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for data, w, o in zip(*(left[k].to_pylist() for k in ("data", "windows", "owners")), strict=True):
            to = (np.frombuffer(w, np.uint64) % np.uint64(buckets)).astype(np.int64)
            smaller = np.zeros(len(to), bool)
            order = np.argsort(to, kind="stable")
            place = dict(zip(*_split(to[order], order), strict=True))
            for b, bits in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True):
                smaller[place[b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(place[b])).astype(bool)
            rows += _finish(data, smaller, np.frombuffer(o, np.int64))
        return pa.Table.from_pylist([dict(zip(_DONE.names[:4], r, strict=True)) for r in rows], schema=pa.schema(list(_DONE)[:4]))

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    rest = blocks.select("block", "data", "windows", "owners").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, result)
    return searched.filter(F.col("block").isNull()).select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest)


def _split(sorted_keys: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Keys in order, and the places of each."""
    if not len(sorted_keys):
        return [], []
    cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
    return sorted_keys[np.r_[0, cuts]].tolist(), np.split(order, cuts)
