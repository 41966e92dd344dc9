"""Token ids of documents in ascending doc_id order, as files of Simple-8b blocks.

A file is a Parquet file whose rows are runs of documents: ids of the documents, ids per document, the packed words and
the word at which each block starts. ``part`` orders the files, ``seq`` the rows of one, and ``before`` counts the token ids of
the rows before it in its file, so a reader needs only one total per file to place any document in the whole stream.

Nulls: a null text is an empty one, which gives its end id alone; null ids sort first. Ties and repeated rows are ordered
by a hash of the text. An empty table gives no files' rows and an empty result. A very long text is a row of a file by itself or the
last of one. Other columns may have any name: only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .common import map_rows, stage_path, text_of

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Token ids after which a row of a file ends.
ROW_IDS = 1 << 17
#: Words and runs between blanks whose ids a Python worker remembers.
REMEMBERED = 1_000_000
FILE = "part int, seq int, before long, doc_ids array<long>, counts array<long>, n_ids long, offsets array<long>, words binary"

# Texts of these characters only, without a special token, are cut into words here, as the vocabulary's own rules say;
# words are then encoded by the library, each once. Every other text goes to the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
#: The vocabulary spells a word by one letter per byte: printable bytes stand for themselves, the others follow from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_OTHERS)}
_ENCODERS: dict[str, Encoder] = {}


class Numbers(dict):
    """Numbers its keys in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n

    def behind(self, n: int) -> list[str]:
        """The keys numbered ``n`` and more."""
        return list(islice(reversed(self), len(self) - n))[::-1]


class Pieces:
    """Runs of ids, by number."""

    def __init__(self):
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.count = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + len(sizes)] = sizes
        self.count, self.used = self.count + len(sizes), self.used + len(ids)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs asked for, one after the other, and how many each has."""
        sizes = self.sizes[which]
        shift = self.starts[which] - (np.cumsum(sizes) - sizes)
        return self.ids[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)], sizes


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    ends = np.cumsum(counts)
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[ends - counts]


class Encoder:
    """The library's ids, with a memory of words and of what stands between blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids = Numbers(), Pieces()
        self.chunks, self.chunk_ids = Numbers(), Pieces()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One in each Python worker."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _learn_words(self, words: list[str]) -> None:
        tokenize = self.library.model.tokenize
        ids = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS))] for w in words]
        self.word_ids.add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn_chunks(self, chunks: list[str]) -> None:
        cut = [_WORDS.findall(c) for c in chunks]
        known = len(self.words)
        which = np.array(list(map(self.words.__getitem__, chain.from_iterable(cut))), np.int64)
        self._learn_words(self.words.behind(known))
        ids, sizes = self.word_ids.take(which)
        self.chunk_ids.add(ids, _sums(sizes, np.array([len(c) for c in cut], np.int64)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) + len(self.chunks) > REMEMBERED:
            self._forget()
        plain = ["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        which, counts = self._chunks_of([t.lower() for t, p in zip(texts, plain, strict=True) if p])
        ids, sizes = self.chunk_ids.take(which)
        data, at = ids.tobytes(), iter((4 * np.r_[0, np.cumsum(_sums(sizes, counts))]).tolist())
        whole = iter(self.library.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        out, a = [], next(at)
        for p in plain:
            if p:
                b = next(at)
                out.append(data[a:b])
                a = b
            else:
                out.append(np.array(next(whole).ids, np.uint32).tobytes())
        return out

    def _chunks_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of what stands between blanks in all texts, and how many each text has; new ones are learnt.

        The texts are cut as one array of bytes, and only what differs in it is looked up.
        """
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        b = np.frombuffer(b"".join(r + b"\n" for r in raw), np.uint8)
        word = b > 0x20
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(b[word])]).dictionary_encode()
        known = len(self.chunks)
        numbers = np.array(list(map(self.chunks.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False).tolist())), np.int64)
        self._learn_chunks(self.chunks.behind(known))
        return numbers[parts.indices.to_numpy()], np.diff(np.searchsorted(start, ends), prepend=0)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the token files of all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    end = np.array([end_id], np.uint32).tobytes()

    def make():
        import public_tokenizers

        encoder = Encoder.of(public_tokenizers.path(vocabulary))
        state = {"seq": 0, "before": 0}
        part = TaskContext.get().partitionId()

        def row(ids: list, data: list) -> dict:
            counts = [len(d) // 4 for d in data]
            values = np.frombuffer(b"".join(data), "<u4")
            words, offsets = simple8b.encode(values)
            out = {"part": part, "seq": state["seq"], "before": state["before"], "doc_ids": ids, "counts": counts, "n_ids": len(values),
                   "offsets": offsets, "words": words.astype("<u8").tobytes()}
            state["seq"] += 1
            state["before"] += len(values)
            return out

        def step(batch: pa.RecordBatch) -> pa.Table:
            out, ids, data, held = [], [], [], 0
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                for name, d in zip(names[i : i + 256], encoder.encode(texts[i : i + 256]), strict=True):
                    ids.append(name)
                    data.append(d + end)
                    held += len(d) // 4 + 1
                    if held >= ROW_IDS:
                        out.append(row(ids, data))
                        ids, data, held = [], [], 0
            if ids:
                out.append(row(ids, data))
            return pa.Table.from_pylist(out, schema=_ARROW)

        return step

    map_rows(rows, make, FILE).write.parquet(path)


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                    ("n_ids", pa.int64()), ("offsets", pa.list_(pa.int64())), ("words", pa.binary())])


def unpack(row: dict) -> np.ndarray:
    """Token ids of a file's row."""
    return simple8b.decode(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64), row["n_ids"]).astype("<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens and the checksum of its ids."""
    files = spark.read.schema(FILE).parquet(path)

    def make():
        def step(batch: pa.RecordBatch) -> pa.Table:
            out: dict[str, list] = {n: [] for n in ("doc_id", "part", "start", "n_tokens", "ids_crc32")}
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = memoryview(unpack(row).tobytes())
                at = 0
                for doc, n in zip(row["doc_ids"], row["counts"], strict=True):
                    for k, v in zip(out, (doc, row["part"], row["before"] + at, n, zlib.crc32(data[4 * at : 4 * (at + n)])), strict=True):
                        out[k].append(v)
                    at += n
            return pa.table({k: pa.array(v, pa.int32() if k == "part" else pa.int64()) for k, v in out.items()})

        return step

    places = map_rows(files, make, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    # one row per file
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    bases = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return places.join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the files and read the documents' places back from them."""
    path = path or stage_path(docs.sparkSession, "token-files")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
