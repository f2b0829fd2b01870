import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm.esort import suffix_sort


def check(data, cap, budget, in_memory, dtype=np.uint8):
    x = np.array(data, dtype)
    got = []
    suffix_sort(x, cap, lambda p, q: got.extend(zip(p.tolist(), q.tolist())), budget, in_memory)
    assert sorted(p for p, _ in got) == list(range(len(x)))
    cut = [tuple(data[p : p + cap]) for p, _ in got]
    assert cut == sorted(cut, reverse=True)
    for (a, b), (_, q) in zip(zip(cut, cut[1:]), got[1:]):
        common = next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        assert q == min(common, cap)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.sampled_from([1, 4, 100]), st.sampled_from([3, 10**6]), st.sampled_from([1, 4, 10**6]))
def test_small_alphabets(data, cap, budget, in_memory):
    check(data, cap, budget, in_memory)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=80), st.sampled_from([3, 10**6]))
def test_large_alphabets(data, budget):
    check(data, 100, budget, 2, np.int32)


@pytest.mark.parametrize("text", [b"a" * 700, b"ab" * 400, b"abcabcabx" * 60 + b"zz" + b"abcabcabx" * 30, bytes(range(256)) * 3])
def test_repetitive(text):
    check(list(text), 100, 50, 8)
    check(list(text), 100, 10**6, 10**6)
