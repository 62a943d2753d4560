"""Documents that are all parts of one, and little alike among themselves."""

import random

import numpy as np

from noticewing.llm import minhash


def test_parts_of_one_text_make_no_row_for_each_pair(spark, monkeypatch):
    """150 choices of 14 of 20 sentences: alike by 0.65 to the whole, by some 0.5 to each other; one has a near copy."""
    rng = random.Random(11)
    sentences = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(20)]
    chosen = []
    while len(chosen) < 150:
        some = set(rng.sample(range(20), 14))
        if all(len(some & other) <= 12 for other in chosen):
            chosen.append(some)
    texts = [" ".join(sentences)] + [" ".join(sentences[k] for k in sorted(some)) for some in chosen]
    texts.append(f"{texts[50]} more")
    pairs, old = [], minhash.written

    def counted(frame):
        out = old(frame)
        if frame.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.duplicate_report(docs).collect()}
    assert got == {k: 50 if k == 151 else k for k in range(152)}
    assert len(pairs) > 2 and max(pairs) <= 1000, pairs


def test_sets_differ_in_no_fewer_shingles_than_their_parities():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (0, 1, 5, 400, 400, 2500)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = minhash.parities(row, np.concatenate(sets), len(sets))
    for a, x in zip(sets, bits):
        for b, y in zip(sets, bits):
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
