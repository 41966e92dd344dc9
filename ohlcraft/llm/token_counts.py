"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers stand for a byte-level BPE vocabulary:

* The *cutter* reads code points as classes (letter, number, other, blank, other white space) and knows where a pre-token
  starts. Its look-back and look-ahead are three code points, so its marks are computed for whole arrays.
* The *counter* reads the bytes of a pre-token. Its states are pre-token prefixes, made when first reached; each knows the
  last token of its prefix's encoding, and each transition the number of tokens that it adds (which may be negative,
  when a byte joins tokens). A prefix's encoding ends in the longest vocabulary entry ``t`` that fits what is before it: with
  ``p`` the last token of the shorter prefix, the pair ``p t`` must itself encode to ``p, t``.

A text is cut into chunks. A chunk's *state map* says what it does to a pre-token left open before it: the code points that
still belong to it (``head``), the tokens emitted after that, and what it leaves open (``tail``). Maps compose, and the
composition is associative, so a text's chunks are combined pairwise in a logarithmic number of rounds.

Nulls: a null text is empty. Empty texts have no tokens; repeated rows are counted alike; an empty table gives an empty result.
The chunks of a very long text are composed in its own task. Other columns may have any name: only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Code points of a chunk.
CHUNK = 1 << 16
#: States of the counter and pre-tokens whose counts are remembered, per Python worker; beyond it they are made anew.
STATES = 400_000
REMEMBERED = 800_000

LETTER, NUMBER, OTHER, BLANK, SPACE, UNKNOWN = range(6)
# Fixed values of the vocabulary's rule for contractions.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Counter:
    """The byte transducer: ``count(word)`` walks it, adding states that are missing."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.tokens = vocabulary
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.longest = max(map(len, vocabulary))
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}  # state * 256 + byte to state
        self.adds: list[int] = [0]  # tokens added by the transition into a state
        self.last: list[bytes] = [b""]  # last token of the state's prefix

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding by repeated merging of the earliest pair; used on two tokens at a time."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, left: bytes, right: bytes) -> bool:
        if not left:
            return True
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > STATES:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def count(self, word: bytes) -> int:
        if len(self.adds) > STATES:
            self.clear()
        path, total, state = [0], 0, 0
        counts = [0]
        for i in range(len(word)):
            to = self.next.get(state << 8 | word[i])
            if to is None:
                to = self._extend(state, word, i + 1, path, counts)
            total += self.adds[to]
            state = to
            path.append(to)
            counts.append(total)
        return total

    def _extend(self, state: int, word: bytes, end: int, path: list[int], counts: list[int]) -> int:
        for start in range(max(0, end - self.longest), end):
            token = word[start:end]
            if token in self.tokens and self._pair(self.last[path[start]], token):
                break
        else:
            raise ValueError("a byte that the vocabulary lacks")
        to = len(self.adds)
        self.next[state << 8 | word[end - 1]] = to
        self.adds.append(counts[start] + 1 - counts[end - 1])
        self.last.append(token)
        return to


@dataclass
class StateMap:
    """What a chunk does to the pre-token that is open before it. ``tail`` is None where no pre-token surely starts in it."""

    head: str
    tokens: int = 0
    tail: str | None = None


class Compiled:
    """Cutter, counter and special tokens of a vocabulary file of the tokenizers library."""

    _made: dict[str, Compiled] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)
        alphabet = byte_alphabet()
        plain = lambda s: bytes(alphabet[c] for c in s)
        special = [a["content"] for a in model["added_tokens"]]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.counter = Counter({plain(t): i for t, i in model["model"]["vocab"].items() if t not in special}, [(plain(a), plain(b)) for a, b in pairs])
        self.special = special
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[0x20] = BLANK
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Compiled:
        """One in each Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points, learned one by one from the library's own cutter."""
        out = self.kind[points]
        if (out == UNKNOWN).any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[out == UNKNOWN]).tolist():
                c = chr(p)
                self.kind[p] = LETTER if len(cut("a" + c)) == 1 else NUMBER if len(cut("1" + c)) == 1 else OTHER if len(cut(f"a{c}!")) == 2 else SPACE
            out = self.kind[points]
        return out

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each code point of a whole text."""
        n = len(points)
        kind = self.classes(points)
        white = kind >= BLANK
        start = np.ones(n, bool)
        if n < 2:
            return start
        before, now = kind[:-1], kind[1:]
        # after a blank nothing but white space starts; otherwise a new class does
        start[1:] = np.where(white[1:], ~white[:-1], (before != BLANK) & (before != now))
        # the last of several white spaces stands alone, or with what follows if it is a blank
        start[1:-1] |= white[:-2] & white[1:-1] & ~white[2:]
        for at in np.flatnonzero((points == 0x27) & start).tolist():
            ahead = "".join(map(chr, points[at : at + 3].tolist()))
            for word in CONTRACTIONS:
                if ahead.startswith(word):
                    start[at + 1 : at + len(word)] = False
                    if at + len(word) < n:
                        start[at + len(word)] = True
                    break
        return start

    def _sum(self, words: list[str]) -> int:
        known, total = self.known, 0
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = self.counter.count(w.encode())
            total += n
        return total

    def words(self, text: str, start: np.ndarray) -> list[str]:
        at = np.flatnonzero(start).tolist()
        return [text[i:j] for i, j in zip(at, [*at[1:], len(text)], strict=True)]

    def whole(self, text: str) -> int:
        """Tokens of a text that is cut on its own."""
        if not text:
            return 0
        return self._sum(self.words(text, self.starts(np.frombuffer(text.encode("utf-32-le"), np.uint32))))

    def map(self, chunk: str) -> StateMap:
        """A chunk's state map. A pre-token surely starts where what is before it isn't white space, four points from the ends."""
        points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        start = self.starts(points)
        sure = np.flatnonzero(start[4:-4] & (self.kind[points[3:-5]] < BLANK)) + 4 if len(points) > 8 else []
        if not len(sure):
            return StateMap(chunk)
        first, last = int(sure[0]), int(sure[-1])
        return StateMap(chunk[:first], self._sum(self.words(chunk[first:last], start[first:last])) if last > first else 0, chunk[last:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """``a`` followed by ``b``."""
        if a.tail is None:
            return StateMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.tokens, a.tail + b.head)
        return StateMap(a.head, a.tokens + self.whole(a.tail + b.head) + b.tokens, b.tail)

    def finish(self, m: StateMap) -> int:
        """Tokens of a text, from the map of all of it: before it nothing is open."""
        return self.whole(m.head) + m.tokens + self.whole(m.tail or "")

    def segment(self, text: str) -> int:
        maps = [self.map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # a round of the reduction: neighbours in pairs
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.finish(maps[0]) if maps else 0

    def count(self, text: str) -> int:
        """Tokens of a text as the library gives them; a special token's string is one token and cuts the text."""
        parts = self.cut.split(text) if self.special else [text]
        return sum(map(self.segment, parts)) + len(parts) - 1


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """n_bytes, n_tokens and over_limit per document, in one pass without a shuffle."""
    rows = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("count_text"))

    def make():
        import public_tokenizers

        compiled = Compiled.of(public_tokenizers.path(vocabulary))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [compiled.count(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    schema = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    return map_rows(rows, make, schema).withColumn("over_limit", F.col("n_tokens") > limit)
