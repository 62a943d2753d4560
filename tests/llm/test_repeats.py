"""Suffix sorting against plain sorting, and removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticewing.llm import registered, repeats, suffixes

from . import cases

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def symbols(texts):
    return np.concatenate([[0], *[np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, 0) for t in texts]]).astype(np.uint16)


def plain_order(s):
    ends = np.flatnonzero(s == 0)
    number = {e: k for k, e in enumerate(ends.tolist())}

    def key(i):
        end = int(ends[np.searchsorted(ends, i)])
        return [(int(x), 0) for x in s[i:end]] + [(0, number[end])]

    return sorted(range(len(s)), key=key)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=30) | st.text("abcdefgh", max_size=30), max_size=12), st.sampled_from([2, 6, suffixes.MANY]))
def test_suffix_order(texts, many):
    old, suffixes.MANY = suffixes.MANY, many
    try:
        s = symbols([t.encode() for t in texts])
        assert suffixes.suffix_order(s).tolist() == plain_order(s)
    finally:
        suffixes.MANY = old


def test_large_groups_and_groups_by_lyndon_prefix():
    rng = random.Random(5)
    texts = [b"a" * 200, b"ab" * 90, b"", *[bytes(rng.choice(b"aab") for _ in range(60)) for _ in range(80)]] * 2
    s = symbols(texts)
    assert suffixes.suffix_order(s).tolist() == plain_order(s)
    groups = suffixes.LyndonGroups(s)
    ends = np.flatnonzero(s == 0)
    prefix = {}
    for i in np.flatnonzero(s).tolist():
        text = s[i : ends[np.searchsorted(ends, i)]].tolist()
        n = next((k for k in range(1, len(text)) if text[k:] < text[:k] + text[k:]), len(text))
        prefix.setdefault(int(groups.first[i]), set()).add(tuple(text[:n]))
    assert all(len(p) == 1 for p in prefix.values())
    assert [p for _, p in sorted(prefix.items())] == sorted(prefix.values(), key=lambda p: next(iter(p)))


def brute(rows):
    texts = [(-1 << 63 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for r, (i, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def odd_rows():
    start = cases.documents(seed=7, n=60)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh éß🙂") for _ in range(140))
    more = ["a" * 3000, "a" * 200, "ab" * 700, passage, "x" + passage[:60] + "y" + passage[70:], passage[:50], passage[:49], passage[1:50] + "q", passage * 3,
            "\x00" * 80 + "z", "z" + "\x00" * 60]
    return start + [(9000 - i, t, *start[0][2:]) for i, t in enumerate(more)] + [(None, passage, *start[0][2:])]


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_removal_equals_brute_force(spark, hot):
    rows = odd_rows()
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 20
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    out = repeats.repeat_report(docs, hot=hot, with_bytes=True).collect()
    got = Counter((None if r["_id"] == -(1 << 63) else r["_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert got == want
    texts = defaultdict(set)
    for r in rows:
        texts[-(1 << 63) if r[0] is None else r[0]].add((r[1] or "").encode())
    for r in out:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]
        assert any(_without(t, r["spans"]) == bytes(r["kept"]) for t in texts[r["_id"]])


def _without(text, spans):
    at, out = 0, b""
    for s in spans:
        out, at = out + text[at : s["start"]], s["end"]
    return out + text[at:]


def test_registered_query(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = registered.QUERIES["op13_suffixes"](spark, str(tmp_path))
    assert out.columns == COLUMNS and Counter(map(tuple, out.collect())) == brute(rows)
    spark.createDataFrame([], cases.SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registered.QUERIES["op13_suffixes"](spark, f"{tmp_path}/none").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from([120, 300, 1 << 17]))
def test_segments_of_a_row_do_not_depend_on_other_rows(rng, chunk):
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.choice([0, 3, 48, 50, 51, 90, 200, 700]))) for _ in range(12)]
    old, repeats.CHUNK = repeats.CHUNK, chunk

    def by_text(order):
        s = repeats.segments(pa.array([texts[k] for k in order]))
        found = defaultdict(set)
        for row, first, size, place, anchor in zip(s.row, s.first, s.size, s.place, s.anchor):
            found[order[row]].add((first - s.rows[row], size, place - s.rows[row], anchor))
        return dict(found)

    try:
        want = by_text(list(range(12)))
        for k, t in enumerate(texts):  # every window in exactly one segment
            assert sorted(p for f, n, *_ in want.get(k, ()) for p in range(f, f + n - 49)) == list(range(max(len(t.encode()) - 49, 0)))
        assert by_text(rng.sample(range(12), 12)) == want
    finally:
        repeats.CHUNK = old
