"""Round trips of the coding."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ohlcraft.llm import simple8b


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, (1 << 64) - 1)), max_size=700), st.sampled_from([1, 7, 64, 4096]))
def test_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v, block)
    assert (simple8b.decode(words, offsets, len(v), block) == v).all()
    for b, start in enumerate(offsets):  # a block alone
        end = offsets[b + 1] if b + 1 < len(offsets) else len(words)
        part = v[b * block : (b + 1) * block]
        assert (simple8b.decode(words[start:end], np.zeros(1, np.int64), len(part), block) == part).all()


def test_runs_are_short():
    assert len(simple8b.encode(np.zeros(4096, np.uint64))[0]) == -(-4096 // 240)
    assert len(simple8b.encode(np.full(4096, 49_000, np.uint64))[0]) == -(-4096 // 3)
