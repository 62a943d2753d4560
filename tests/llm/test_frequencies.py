"""Near-duplicate weights by the document frequency of every shingle."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from noticewing.llm import minhash


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_rare_shingles_are_weighed_by_their_documents(spark):
    """160 shingles in 3 of 400 documents, 20 in one: alike by count (0.8), not by TF-IDF (0.79)."""
    rng = random.Random(3)
    shared = prose(rng, 165)
    rows = [(1, f"{shared} {prose(rng, 20)}"), (2, f"{shared} {prose(rng, 20)}"), (3, f"{shared} {prose(rng, 600)}")]
    rows += [(k, prose(rng, 30)) for k in range(4, 401)]
    same = prose(rng, 200)
    rows[10:12] = [(11, f"{same} one two"), (12, f"{same} three")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 11 if k == 12 else k for k in range(1, 401)}


def test_frequencies_equal_a_count_of_all_documents():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 40)]
    steps = minhash.Frequencies(3)
    buckets = [pa.table({"bucket": pa.array([b] * 10, pa.int32()), "text": texts[10 * b : 10 * b + 10]}) for b in range(4)]
    asked = [row for t in buckets for row in steps.ask(t).to_pylist()]
    answers = pa.concat_tables([steps.answer([r for r in asked if r["shard"] == p]) for p in range(3)])
    shingles = lambda t: np.concatenate([b[3] for b in steps.blocks(t)]) >> np.uint64(64 - minhash.KEY_BITS)
    want, n = np.unique(np.concatenate([shingles(t) for t in buckets]), return_counts=True)
    assert (n == 1).any() and (n > 3).any()
    for b, t in enumerate(buckets):
        some, total = steps.totals(steps.blocks(t), answers.filter(pa.compute.equal(answers.column("bucket"), b)))
        assert some.tolist() == np.unique(shingles(t)).tolist() and total.tolist() == n[np.searchsorted(want, some)].tolist()
