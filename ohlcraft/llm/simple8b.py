"""Simple-8b: non-negative integers packed into 64-bit words.

The top four bits of a word select how many values the other sixty hold and how wide each is. Selector 0 is a run of 240
zeros; selector 1 is an escape: the word after it holds one value of more than sixty bits. A block of values is padded
with zeros to whole words, and its reader cuts it to the known count. Blocks start at known words, so any block can be
decoded alone, and a block is decoded with a few array operations per selector that occurs in it.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: count and width by selector.
COUNT = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
#: Values of a block.
BLOCK = 4096
_PAD = 240


_SMALL = np.array([v.bit_length() for v in range(1 << 16)], np.int8)


def _widths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < len(_SMALL):
        return _SMALL[values.astype(np.int64)]
    width = np.zeros(len(values), np.int8)
    small = values < (1 << 52)
    width[small] = np.frexp(values[small].astype(np.float64))[1]
    width[~small] = [int(v).bit_length() for v in values[~small]]
    return width


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block of ``block`` values starts. All blocks are packed together."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // block)
    padded = np.zeros((blocks, block + _PAD), np.uint64)
    whole = np.zeros(blocks * block, np.uint64)
    whole[:n] = values
    padded[:, :block] = whole.reshape(blocks, block)
    # widest of the next 1, 2, 3, ... values at each position, each from two shorter windows
    widest = {1: _widths(padded.ravel()).reshape(padded.shape)}
    for c in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120, 240):
        half = max(k for k in widest if k <= c)
        rest = min(k for k in widest if k >= c - half)
        a, b = widest[half], widest[rest][:, c - rest :]
        widest[c] = np.maximum(a[:, : b.shape[1]], b[:, : a.shape[1]])
    # the selector that packs the most values into a word that starts at a position
    selector = np.full((blocks, block), ESCAPE, np.int8)
    for s in range(15, -1, -1):
        if s != ESCAPE:
            np.copyto(selector, np.int8(s), where=widest[int(COUNT[s])][:, :block] <= int(WIDTH[s]))
    counts, starts, sizes = COUNT.tolist(), [], []
    for k in range(blocks):
        kinds, i, end, base, before = selector[k].tobytes(), 0, min(block, n - k * block), k * (block + _PAD), len(starts)
        while i < end:
            starts.append(base + i)
            i += counts[kinds[i]]
        sizes.append(len(starts) - before)
    start, flat = np.array(starts, np.int64), padded.ravel()
    kind = selector[start // (block + _PAD), start % (block + _PAD)]
    raw = kind == ESCAPE
    at = np.arange(len(start)) + np.cumsum(raw) - raw
    out = np.zeros(len(start) + int(raw.sum()), np.uint64)
    for s in np.unique(kind):
        mine = kind == s
        first, to = start[mine], at[mine]
        word = np.full(len(first), int(s) << 60, np.uint64)
        if s == ESCAPE:
            out[to + 1] = flat[first]
        elif s:
            for k in range(COUNT[s]):
                word |= flat[first + k] << np.uint64(k * WIDTH[s])
        out[to] = word
    return out, at[np.cumsum(sizes) - sizes]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of all blocks; ``words[offsets[b]:offsets[b + 1]]`` alone decode to block ``b``."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    at = 0
    for h in np.flatnonzero(selector == ESCAPE).tolist():  # a raw word may look like an escape itself
        if h >= at:
            raw[h + 1] = True
            at = h + 2
    count = np.where(raw, 0, COUNT[selector])
    first = np.cumsum(count) - count
    blocks = np.arange(len(offsets))
    sizes = np.diff(np.append(offsets, len(words)))
    first += np.repeat(blocks * block - first[offsets], sizes)
    limit = np.repeat(np.minimum((blocks + 1) * block, n), sizes)
    whole = first + count <= limit
    for s in range(16):
        mine = np.flatnonzero((selector == s) & whole & ~raw)
        if s and len(mine):
            if s == ESCAPE:
                out[first[mine]] = words[mine + 1]
                continue
            word, to, mask = words[mine], first[mine], np.uint64((1 << int(WIDTH[s])) - 1)
            for k in range(COUNT[s]):
                out[to + k] = (word >> np.uint64(k * WIDTH[s])) & mask
    for i in np.flatnonzero(~whole & ~raw).tolist():  # the last word of a block
        s, to = int(selector[i]), int(first[i])
        for k in range(int(limit[i]) - to):
            out[to + k] = int(words[i + 1]) if s == ESCAPE else int(words[i]) >> k * int(WIDTH[s]) & (1 << int(WIDTH[s])) - 1 if s else 0
    return out
