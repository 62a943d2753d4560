"""Strings that share no window with another are not sorted, and no result changes."""

import numpy as np

from noticewing.llm import repeats


def test_only_strings_that_may_share_a_window_are_sorted(monkeypatch):
    rng = np.random.default_rng(4)
    anchor = bytes(rng.integers(97, 123, 16, dtype=np.uint8))
    side = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    a, b = side(20), side(34)
    strings = [side(30) + anchor + side(34) for _ in range(40)] + [a + anchor + b, a + anchor + b[:20] + side(14), side(4) + a[4:] + anchor + b]
    low = rng.permutation(len(strings))
    first = {}
    for t, d in zip(strings, low.tolist()):
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], d), d)
    sorted_, order = [], repeats.suffix_order
    monkeypatch.setattr(repeats, "suffix_order", lambda s: sorted_.append(int((s == 0).sum()) - 1) or order(s))
    size = np.array([len(t) for t in strings])
    got, start = repeats.first_documents(np.frombuffer(b"".join(strings), np.uint8), size, np.array([t.index(anchor) for t in strings]), low)
    assert got.tolist() == [first[t[k : k + 50]] for t in strings for k in range(len(t) - 49)]
    assert sorted_ == [3]
