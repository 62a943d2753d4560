"""Segments that share no window with another are not indexed, and no result changes."""

import numpy as np

from noticewing.llm import substrings


def test_only_segments_that_may_share_a_window_are_indexed(monkeypatch):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    anchor, a, b = words(3), words(10), words(10)
    segments = [words(8) + anchor + words(8) for _ in range(30)] + [a + anchor + b, a + anchor + b[:4] + words(4), words(2) + a[2:] + anchor + b]
    segments += [segments[0], segments[30], segments[0]]
    low = rng.permutation(len(segments))
    first = {}
    for t, d in zip(segments, low.tolist()):
        for k in range(len(t) - 12):
            w = tuple(t[k : k + 13])
            first[w] = min(first.get(w, d), d)
    indexed, index = [], substrings.FmIndex
    monkeypatch.setattr(substrings, "FmIndex", lambda body, n, most: indexed.append(int((body == 0).sum())) or index(body, n, most))
    windows, got = substrings._first_documents("".join(" ".join(t) + "\n" for t in segments).encode(), low)
    assert windows.tolist() == [len(t) - 12 for t in segments]
    assert got.tolist() == [first[tuple(t[k : k + 13])] for t in segments for k in range(len(t) - 12)]
    assert indexed == [3]
