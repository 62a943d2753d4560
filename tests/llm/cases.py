"""Small documents with everything that may go wrong, and brute-force versions of the operators."""

import random
import re
from collections import Counter
from math import log

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _id int, bucket string, shard string, node string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(k))
    shared = prose(60)
    texts = [None, "", "   ", "\n\n\n", "one", "two words", "the end\nthe end", "a b c d e", prose(5000)]
    base = prose(120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(30) + "\n" + shared + "\n" + prose(20))
        elif kind == 3:
            texts.append("\n".join([prose(12), "The same line as everywhere else in here.", prose(9)]))
        elif kind == 4:
            texts.append(prose(40) + " ünïcödé <|endoftext|> 🙂 " + "x" * 300)
        else:
            texts.append(prose(rng.randrange(1, 80)))
    rows = [(7 * k % 1000, t) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, prose(40)), (None, base), (-5, base)]
    return [(i, t, "en", "s", None if t is None else len(t), 1, "b", "c", "d") for i, t in rows]


def words(text):
    return WORD.findall(text or "")


def kept_lines(rows, t=0.8):
    """Line numbers that go, by (doc_id, text)."""
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    return order


def substring_removed(rows):
    first = {}
    key = lambda i: float("-inf") if i is None else i
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, float("inf")), key(r[0]))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(r[0]):
                gone[k : k + 13] = [True] * 13
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def near_groups(texts, threshold=0.8, share=0.01, damping=0.25):
    """Component of every different text: weighted Jaccard of five-word shingles, all pairs."""
    texts = list(texts)
    bags = []
    for t in texts:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return bags, texts


def weighted(bags, n_docs, df, share=0.01, damping=0.25):
    def one(s, c):
        idf = min(1.0, max(0.0, log(n_docs / df[s]) / log(1 / share))) if df[s] >= share * n_docs else 1.0
        return c * (1 + damping * idf) / (1 + damping)

    return [{s: one(s, c) for s, c in b.items()} for b in bags]


def jaccard(a, b):
    common = sum(min(v, b[s]) for s, v in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0
