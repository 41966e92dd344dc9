"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Items and documents are lower-cased (A-Z only) and cut into words; an item gives a window for each run of ten words, or
one window if it is shorter. The windows, as `` word word ... `` with a blank at both ends, are the automaton's strings,
so a single scan of a document's normalised text finds every window at word ends, and word numbers map the hits back to
code points of the original.

The benchmark is measured first. Windows of up to ``AUTOMATON_CHARS`` characters make one automaton, which is broadcast;
a larger benchmark is cut by hash into several of that size, scanned one after the other in the same pass over a row.

Nulls: a null text has no words, so it is neither hit nor hits; an item with a null id still hits words but isn't listed.
Texts without words, repeated items and empty tables need no special case: they give no windows or no hits. A very long text is
scanned whole by one task. Other columns may have any name; ``clean`` returns them as they are.
"""

from __future__ import annotations

import bisect
import re
import uuid
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WINDOW = 10
AUTOMATON_CHARS = 16 << 20
#: After lower-casing A-Z, a word is a run of digits, a-z and everything beyond ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_NORMAL = {c: " " for c in range(0x80) if not WORD.match(chr(c))} | {c: chr(c + 32) for c in range(0x41, 0x5B)}
_LOWER = {c: chr(c + 32) for c in range(0x41, 0x5B)}
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def words(text: str) -> list[str]:
    return [w for w in text.translate(_NORMAL).split(" ") if w]


def windows(benchmark: DataFrame, size: int = WINDOW, id_column: str = "item_id") -> DataFrame:
    """phrase and the ids of the items that hold it."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.Table:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text or "")
                out += [(item, f" {' '.join(w[i : i + size])} ") for i in range(max(1, len(w) - size + 1))] if w else []
            return pa.table({"item": pa.array([i for i, _ in out], pa.string()), "phrase": pa.array([p for _, p in out], pa.string())})

        return step

    rows = map_rows(benchmark.select(F.col(id_column).cast("string"), "text"), make, "item string, phrase string")
    return rows.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def automata(found: DataFrame, limit: int = AUTOMATON_CHARS) -> list:
    """Broadcasts of at most about ``limit`` characters of windows each."""
    spark = found.sparkSession
    chars = found.agg(F.sum(F.length("phrase") + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x)))).first()[0] or 0
    parts = max(1, -(-chars // limit))
    out = []
    for part in range(parts):
        rows = found.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast([(r.phrase, list(r["items"])) for r in rows])))
    return out


def _automaton(key: str, phrases: list) -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear() if len(_AUTOMATA) > 8 else None
        made = ahocorasick.Automaton()
        for phrase, items in phrases:
            made.add_word(phrase, (phrase.count(" ") - 1, items))
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_text(text: str, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, word spans that windows cover, ids of the items whose windows occur."""
    w = words(text)
    spans, items, starts = [], set(), None
    if w and len(automaton):
        for end, (count, ids) in automaton.iter(f" {' '.join(w)} "):
            if starts is None:
                starts = list(accumulate((len(x) + 1 for x in w), initial=0))
            last = bisect.bisect_left(starts, end)
            spans.append((last - count, last))
            items.update(ids)
    return len(w), merged(spans), items


def originals(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that spans of words cover."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


SCAN = "n_words long, hits array<struct<word_start:int,word_end:int,start:int,end:int>>, items array<string>"


def _scanned(docs: DataFrame, benchmark: DataFrame, size: int, limit: int, columns: list[str]) -> DataFrame:
    """``columns`` of each document as keep_0, keep_1, ... with n_words, hits and items."""
    rows = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(columns)], F.col("text").alias("scan_text"),
                       F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<word_start:int,word_end:int,start:int,end:int>>)").alias("hits"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    schema = rows.schema
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("word_start", "word_end", "start", "end")]))
    for key, phrases in automata(windows(benchmark, size), limit):

        def make(key=key, phrases=phrases):
            automaton = _automaton(key, phrases.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, hits, items = [], [], []
                for text, old, had in zip(*(batch.column(n).to_pylist() for n in ("scan_text", "hits", "items")), strict=True):
                    n, spans, found = scan_text(text or "", automaton)
                    spans = merged(spans + [(h["word_start"], h["word_end"]) for h in old])
                    counts.append(n)
                    hits.append([{"word_start": a, "word_end": b, "start": c, "end": d} for (a, b), (c, d) in zip(spans, originals(text or "", spans), strict=True)])
                    items.append(sorted(found.union(had)))
                keep = {n: batch.column(n) for n in batch.schema.names}
                return pa.RecordBatch.from_pydict(keep | {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, kind), "items": pa.array(items, pa.list_(pa.string()))})

            return step

        rows = map_rows(rows, make, schema)
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """doc_id, n_words, hits (spans in words and in code points) and items of each document."""
    return _scanned(docs, benchmark, size, limit, ["doc_id"]).select(F.col("keep_0").alias("doc_id"), "n_words", "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: words, words hit, items and their digest."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["word_end"] - h["word_start"]))
    return scan(docs, benchmark, size).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without a window of any item, in one pass and without a shuffle."""
    columns = docs.columns
    return _scanned(docs, benchmark, size, AUTOMATON_CHARS, columns).filter(F.size("hits") == 0).select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(columns)])
