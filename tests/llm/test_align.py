"""Cross-tokenizer alignment against a byte-by-byte brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from noticewing.llm import align, registered
from noticewing.llm.bpe import _byte_signs
from noticewing.llm.registered import tokenizer_path

from . import cases

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "<|endoftext|> in <s> text </s><unk>", "naïve façade — “quotes” … 東京タワー 🙂🙂", "ﬁ ligature ½ Å", "tab\tand\n\nfeeds  two   spaces ", " led", "▁ sign",
    "x" * 5000, "é combining", "Привет, мир", "\u0000 nul", "a b", "١٢٣ ٤", "ꙮ \U0001e94b", " ", "<0x41>",
]


def brute(rows):
    library = tokenizers.Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = {c: b for b, c in enumerate(_byte_signs())}
    cuts = []
    for r in rows:
        text = r[1] or ""
        a = library.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        ta = [bytes(signs[c] for c in library.id_to_token(i)) for i in a]
        tb = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        cuts.append((a, b, ta, tb) if text and b"".join(ta) == want and b"".join(tb) == want else ([], [], [], []))
    found, counts = [], Counter()
    for a, b, ta, tb in cuts:
        owner_a = [i for i, t in enumerate(ta) for _ in t]
        owner_b = [i for i, t in enumerate(tb) for _ in t]
        links = list(dict.fromkeys(zip(owner_a, owner_b)))
        ends = [k for k in range(len(owner_a)) if k + 1 == len(owner_a) or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1])]
        groups, i, j = [], 0, 0
        for k in ends:
            p, q = owner_a[k] + 1, owner_b[k] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        found.append((len(a), len(b), groups, pairs))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter(
        (r[0], na, nb, len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "")
        for r, (na, nb, groups, pairs) in zip(rows, found))


@pytest.fixture(scope="module")
def rows():
    start = cases.documents(seed=4, n=30)
    return start + [(5000 + i, t, *start[0][2:]) for i, t in enumerate(ODD)]


def test_alignment_equals_brute_force(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    want = brute(rows)
    assert any(r[1] for r in want) and any(not r[1] for r in want)
    assert Counter(tuple(r) for r in align.linked(docs, A, B).select(COLUMNS).collect()) == want
    # Few pairs at once: several passes give the same sums.
    assert Counter(tuple(r) for r in align.linked(docs, A, B, pairs_at_once=500).select(COLUMNS).collect()) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = registered.QUERIES["op12_alignment"](spark, str(tmp_path))
    assert out.columns == COLUMNS and Counter(map(tuple, out.collect())) == want


def test_real_outputs_and_names(spark):
    docs = spark.createDataFrame([(1, "the same words", 7, "x"), (1, "the same words", 7, "x"), (None, None, None, None)], "doc_id long, text string, n_a int, _r string")
    rows = align.aligned(docs, A, B).collect()
    assert [r["n_groups"] for r in rows] == [3, 3, 0] and rows[0]["groups"].count(";") == 2 and len(rows[0]["links"]) == 3
    out = align.linked(docs, A, B)
    assert out.columns == ["doc_id", "_r", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r["count_sum"], r["_r"] or "") for r in out.collect()) == [(0, ""), (6, "x"), (6, "x")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.linked(none, A, B).count() == 0


def test_overlaps():
    a, b, group_a, group_b = align.overlaps(np.array([2, 3, 1, 4]), np.array([4, 2, 4]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2)]
    assert group_a.tolist() == [0, 0, 0, 1] and group_b.tolist() == [0, 0, 1]


def test_windows_are_remembered():
    one = align.aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    one._forget()
    first = one.texts(["some words and some words", "", "and some more"])
    n = len(one.known)
    again = one.texts(["some words and some words", "", "and some more"])
    assert len(one.known) == n < 8 and first[3] == again[3] and (first[5] == again[5]).all()
