"""Packing, BPE, sharding, line, substring and near-duplicate operators against brute force."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticewing.llm import bpe, lines, minhash, packing, sharding, substrings
from noticewing.llm.common import word_hashes, word_spans
from noticewing.llm.fmindex import FmIndex, matched
from noticewing.llm.registered import tokenizer_path

from . import cases

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"ab cd ab \xc3\xa9 ab" + b"x" * 600_000 + b" ab", dtype=np.uint8)
    starts, ends, first = word_spans(data, np.array([0, 5, len(data)]))
    h = word_hashes(data, starts, ends)
    assert first.tolist() == [0, 2, len(starts)] and h[0] == h[2] == h[-1] and len(set(h.tolist())) == 4


def test_bpe_equals_the_library(docs, rows, none):
    path = tokenizer_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = Counter(tuple(r) for r in bpe.token_digests(docs, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    assert bpe.token_digests(none, path).count() == 0
    full = bpe.tokenized(docs.where("text is not null"), path).collect()
    assert all(r["decoded"] == r["text"] and len(r["ids"]) == r["n_tokens"] for r in full)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_bpe_round_trip(texts):
    path = tokenizer_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    codec = bpe.codec(open(path, encoding="utf-8").read())
    for t, (ids, n, raw) in zip(texts, codec.both(texts)):
        assert ids == ",".join(map(str, library.encode(t, add_special_tokens=False).ids)) and raw.decode() == t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_packing_ids_equal_the_library(texts):
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    ids, rows = packing.word_ids(open(path, encoding="utf-8").read())(pa.array([*texts, None], pa.string()))
    for t, a, b in zip([*texts, ""], rows[:-1], rows[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_ids_of_every_near_sign_and_forgotten_words(monkeypatch):
    """Every sign up to U+0260 alone, in a word and in upper case, words beyond the memory, special tokens."""
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "GATHERED", 7)
    encode = packing.WordIds(open(path, encoding="utf-8").read())
    signs = [chr(c) for c in range(1, 0x260)]
    texts = [f"{c} a{c}b'{c}S {c}{c}7" for c in signs] + ["", "<|endoftext|> it's", "\u0391\u03a3 \x1c\xa0x\x85"]
    for _ in range(2):
        ids, rows = encode(pa.array(texts))
        for t, a, b in zip(texts, rows[:-1], rows[1:]):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_cover_the_histogram(histogram):
    patterns = packing.spfhp(histogram, 64)
    used = Counter()
    for count, content in patterns:
        assert count > 0 and sum(n * k for n, k in content) <= 64
        for n, k in content:
            used[n] += count * k
    assert dict(used) == histogram


def test_packing(docs, rows, none):
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = packing.packed(docs, path, capacity=128, end_id=1).collect()
    texts = Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 128):
            part = ids[s : s + 128]
            texts[(r[0], s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == texts
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.packed(none, path, capacity=128).count() == 0


def test_packed_sequences_hold_every_token(docs, rows):
    path = tokenizer_path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    sequences, parts = {}, {}
    for r in packing.packed(docs, path, capacity=128, end_id=1).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], {})[r["offset"]] = r["ids"]
        parts[(r["doc_id"], r["doc_tokens"], r["start"])] = r["ids"]
    whole = [[t for _, ids in sorted(s.items()) for t in ids] for s in sequences.values()]
    texts = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    assert all(len(s) <= 128 for s in whole) and Counter(t for s in whole for t in s) == Counter(t for x in texts for t in x)
    for r, want in zip(rows, texts):
        assert [t for s in range(0, len(want), 128) for t in parts[(r[0], len(want), s)]] == want


def test_sharding(spark, docs, rows, none):
    sized = docs.selectExpr("*", "coalesce(octet_length(text), 0) + 16 AS size")
    got = sharding.range_shards(sized, "doc_id", "size", 7, rows_per_range=5).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert all(abs(s - sum(sizes.values()) / 7) <= largest for s in sizes.values())
    assert sharding.range_shards(none.selectExpr("*", "1 AS size"), "doc_id", "size", 7).count() == 0
    same = spark.createDataFrame([(1, 3)] * 100, "doc_id long, size long")  # one key, repeated rows
    counts = Counter(r["shard"] for r in sharding.range_shards(same, "doc_id", "size", 4, rows_per_range=10).collect())
    assert counts == {0: 25, 1: 25, 2: 25, 3: 25}


def test_substrings(docs, rows, none):
    got = Counter((r["_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.window_report(docs).collect())
    low = -(1 << 63)
    want = Counter((low if i is None else i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in cases.substring_removed(rows))
    assert got == want and sum(n for _, _, n, _ in got) > 500
    out = substrings.deduped(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {(r["doc_id"], " ".join(cases.words(r["text"]))) for r in out.collect()}
    assert texts == {(i, t) for i, _, _, t in cases.substring_removed(rows)}
    assert substrings.window_report(none).count() == 0 and substrings.deduped(none).count() == 0


def test_index_finds_what_is_there():
    rng = np.random.default_rng(3)
    body = np.append(rng.integers(1, 6, 300), 0)
    index = FmIndex(body, 5, 512)
    patterns, size = rng.integers(1, 6, 60), np.full(10, 6)
    first = np.arange(10) * 6
    for live, place, depth, low, high in matched(index, patterns, first, size):
        for p, k, a, b in zip(live, place, low, high):
            wanted = patterns[first[p] + k : first[p] + k + depth].tolist()
            where = [i for i in range(len(body)) if body[i : i + depth].tolist() == wanted]
            assert sorted(index.order[a:b].tolist()) == where


def brute_lines(rows, t=0.8):
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = [], {}
    for i, text in docs:
        for k, line in enumerate(text.split("\n")):
            s = frozenset(cases.words(line))
            if s:
                if any(len(s & o) / len(s | o) >= t for o in seen):
                    out.setdefault((i, text), set()).add(k)
                seen.append(s)
    return out


def test_lines(docs, rows, none):
    some = [r for r in rows if r[0] is not None]  # two null keys differ in their hash order only
    frame = docs.where("doc_id is not null")
    want = brute_lines(some)
    got = {(r["doc_id"], len(r["removed_lines"])): set(r["removed_lines"]) for r in lines.line_report(frame).collect()}
    for (i, text), gone in want.items():
        assert got[(i, len(gone))] == gone
    assert sum(n for _, n in got) == sum(map(len, want.values()))
    out = lines.deduped(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert lines.line_report(none).count() == 0 and lines.deduped(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=4, max_size=40), st.sets(st.integers(0, 60), max_size=4), st.sets(st.integers(0, 60), max_size=4))
def test_similar_sets_share_a_pair_of_the_prefix(base, less, more):
    a, b = sorted(base), sorted((base - less) | more)
    if len(b) < 4 or set(a) == set(b) or len(set(a) & set(b)) / len(set(a) | set(b)) < 0.8:
        return
    prefix = lambda s: s[: int(lines.pair_prefix(np.array([len(s)]), Fraction(4, 5))[0])]
    pairs = [{(x, y): (k, len(s)) for k, (x, y) in enumerate(zip(prefix(s), prefix(s)[1:]))} for s in (a, b)]
    common = pairs[0].keys() & pairs[1].keys()
    assert common
    for p in common:
        (i, n), (j, m) = pairs[0][p], pairs[1][p]
        assert lines.filtered(np.array([n]), np.array([i]), np.array([m]), np.array([j]), Fraction(4, 5))[0]


def test_large_groups_of_similar_lines(spark):
    base = [f"t{i}" for i in range(20)]
    rows = [(k, " ".join(base[:j] + [f"v{k}"] + base[j + 1 :])) for k, j in enumerate([*range(20), *range(20)])]
    got = {r["doc_id"]: r["n_removed"] for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines([(i, t) for i, t in rows])
    assert {i: int((i, t) in want) for i, t in rows} == got


def brute_groups(rows):
    texts = sorted({r[1] or "" for r in rows})
    bags, _ = cases.near_groups(texts)
    bag_of = dict(zip(texts, bags))
    df = Counter(s for r in rows for s in bag_of[r[1] or ""])
    weights = cases.weighted(bags, len(rows), df)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if cases.jaccard(weights[a], weights[b]) >= 0.8:
                parent[find(a)] = find(b)
    return {t: (find(k) if bags[k] else None) for k, t in enumerate(texts)}


def test_minhash(docs, rows, none):
    some = [r for r in rows if r[0] is not None]
    group = brute_groups(some)
    least = {}
    for r in some:
        g = group[r[1] or ""]
        if g is not None:
            least[g] = min(least.get(g, 10**9), r[0])
    want = Counter()
    for r in some:
        g = group[r[1] or ""]
        want[(r[0], r[0] if g is None else least[g])] += 1
    got = minhash.duplicate_report(docs.where("doc_id is not null").distinct()).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want)
    kept = minhash.deduped(docs)
    assert kept.columns == docs.columns
    worded = [r["text"] for r in kept.collect() if cases.words(r["text"])]
    assert len(worded) == len({brute_groups(rows)[t] for t in worded}) == len({g for g in brute_groups(rows).values() if g is not None})
    assert kept.count() - len(worded) == sum(not cases.words(r[1]) for r in rows)
    assert minhash.duplicate_report(none).count() == 0 and minhash.deduped(none).count() == 0


def test_samples_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    found = rng.integers(1, 1 << 63, 400).astype(np.uint64)
    found.sort()
    a, b = rng.integers(1, 4, 400).astype(float), rng.integers(0, 4, 400).astype(float)
    s = minhash.sketch(np.zeros(400, np.int64), found, a, 1, 600)
    keep = b > 0
    u = minhash.sketch(np.zeros(int(keep.sum()), np.int64), found[keep], b[keep], 1, 600)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s == u).mean() - true) < 0.07
