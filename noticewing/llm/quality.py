"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import batches_of, free_name, mixed, text_bytes, uniform, without, word_hashes, word_spans

#: labelled documents the model is fitted on at most, per label
SAMPLE_PER_LABEL = 2500
#: words of a passage; bins of byte pairs
PASSAGE, PAIRS = 64, 256
HIDDEN, ATTENTION = 24, 12
#: what a passage is described by: single bytes below 128, byte pairs by hash, and five shape figures
WIDTH = 128 + PAIRS + 5


def _passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Blocks of documents as (passage vectors, document of each passage, first and end row)."""
    data, rows = text_bytes(column)
    for i, j in batches_of(rows, 1 << 20):
        at = rows[i : j + 1]
        part = data[at[0] : at[-1]]
        starts, ends, first = word_spans(part, at - at[0])
        sizes = np.diff(first)
        per_doc = np.maximum(1, -(-sizes // PASSAGE))
        doc = np.repeat(np.arange(j - i), per_doc)
        base = np.concatenate(([0], np.cumsum(per_doc)))
        within = np.arange(len(starts)) - np.repeat(first[:-1], sizes)
        passage = np.repeat(base[:-1], sizes) + within // PASSAGE
        n = int(base[-1])
        x = np.zeros((n, WIDTH), dtype=np.float32)
        length = ends - starts
        if len(starts):
            n_words = np.maximum(np.bincount(passage, minlength=n), 1)
            n_bytes = np.maximum(np.bincount(passage, weights=length, minlength=n), 1)
            flat = np.repeat(passage, length)
            skip = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length)
            signs = part[np.arange(len(flat)) + skip].astype(np.int64)
            ascii_ = signs < 128
            x[:, :128] = np.sqrt(np.bincount(flat[ascii_] * 128 + signs[ascii_], minlength=n * 128).reshape(n, 128) / n_bytes[:, None])
            pair = (mixed((signs[:-1] * 256 + signs[1:]).astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
            same = flat[:-1] == flat[1:]
            x[:, 128 : 128 + PAIRS] = np.sqrt(np.bincount(flat[:-1][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS) / n_bytes[:, None])
            word = word_hashes(part, starts, ends)
            order = np.lexsort((word, passage))
            p, w = passage[order], word[order]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
            upper = (signs >= 0x41) & (signs <= 0x5A)
            letter = upper | ((signs >= 0x61) & (signs <= 0x7A)) | ~ascii_
            mean = n_bytes / n_words
            x[:, -5] = np.bincount(p[new], minlength=n) / n_words
            x[:, -4] = np.minimum(mean / 10, 3)
            x[:, -3] = np.bincount(flat[upper], minlength=n) / n_bytes
            x[:, -2] = np.bincount(flat[~letter], minlength=n) / n_bytes
            x[:, -1] = np.log1p(n_words) / np.log1p(PASSAGE)
        yield x, doc, i, j


def _by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums over each document's passages; every document has one at least, in order."""
    return np.add.reduceat(values, np.searchsorted(doc, np.arange(n)), axis=0)


@dataclass
class AttentionModel:
    """Passage encoder, gated attention and a linear score: w . tanh-sigmoid gate, softmax in the document."""

    weights: dict[str, np.ndarray]

    def parts(self, x: np.ndarray, doc: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh((x - w["mean"]) / w["scale"] @ w["W"] + w["b"])
        u, g = np.tanh(h @ w["U"]), 1 / (1 + np.exp(-(h @ w["G"])))
        a = (u * g) @ w["a"]
        top = np.maximum.reduceat(a, np.searchsorted(doc, np.arange(n)))
        e = np.exp(a - top[doc])
        share = e / _by_doc(e, doc, n)[doc]
        z = _by_doc(share[:, None] * h, doc, n)
        p = 1 / (1 + np.exp(-np.clip(z @ w["v"] + w["c"], -30, 30)))
        return {"h": h, "u": u, "g": g, "share": share, "z": z, "p": p}


def fit_attention(x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = 25, batch: int = 128, rate: float = 0.01, l2: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the weighted log loss of the documents; gradients of every part by hand."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    w = {
        "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "G": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "v": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
        "mean": mean.astype(float), "scale": scale.astype(float),
    }
    model = AttentionModel(w)
    learned = ("W", "b", "U", "G", "a", "v", "c")
    m, s = {k: np.zeros_like(w[k]) for k in learned}, {k: np.zeros_like(w[k]) for k in learned}
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            some = np.sort(order[i : i + batch])
            sizes = first[some + 1] - first[some]
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in some])
            d, n = np.repeat(np.arange(len(some)), sizes), len(some)
            f = model.parts(x[at].astype(float), d, n)
            h, u, g, share = f["h"], f["u"], f["g"], f["share"]
            err = (f["p"] - y[some]) * weight[some] / weight[some].sum()
            dz = err[:, None] * w["v"]
            d_share = (h * dz[d]).sum(axis=1)
            da = share * (d_share - _by_doc(share * d_share, d, n)[d])
            du, dg = da[:, None] * w["a"] * g * (1 - u**2), da[:, None] * w["a"] * u * g * (1 - g)
            dh = (share[:, None] * dz[d] + du @ w["U"].T + dg @ w["G"].T) * (1 - h**2)
            grads = {
                "W": ((x[at] - mean) / scale).T @ dh + l2 * w["W"], "b": dh.sum(axis=0), "U": h.T @ du, "G": h.T @ dg,
                "a": ((u * g) * da[:, None]).sum(axis=0), "v": f["z"].T @ err + l2 * w["v"], "c": np.array([err.sum()]),
            }
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for k in learned:
                m[k], s[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * s[k] + 0.001 * grads[k] ** 2
                w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


@F.arrow_udf(T.StructType().add("bag", "binary"))
def _described(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in text:
        bags = []
        for x, doc, i, j in _passages(column):
            half = x.astype(np.float16)
            edge = np.searchsorted(doc, np.arange(j - i + 1))
            bags += [half[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
        yield pa.StructArray.from_arrays([pa.array(bags, type=pa.binary())], ["bag"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, per_label: int = SAMPLE_PER_LABEL, key: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel | None:
    """Model from a bounded sample: of each label the `per_label` documents with the smallest key hashes.

    `usable` (a condition on the label rows) keeps held-out rows out of training. Labels other than 0
    and 1, null keys and labels without a document are left out; of a key's labels the smallest
    counts. The loss weighs both classes as often as they occur. None where a class is missing.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"))
    sizes = {int(r[0]): int(r[1]) for r in marks.groupBy("_y").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    picked = None
    for y in (0, 1):
        part = marks.where(F.col("_y") == y).orderBy(uniform("_k"), "_k").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    # At most two samples of key and label: their size does not grow with the data.
    got = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(picked), "_k")
    got = got.dropDuplicates(["_k"]).select("_k", "_y", _described("_t").alias("_b")).select("_k", "_y", "_b.bag").toArrow().sort_by("_k")
    y = got["_y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(b, dtype=np.float16).reshape(-1, WIDTH) for b in got["bag"].to_pylist()]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    return fit_attention(np.concatenate(bags).astype(np.float32), doc, y, weight)


def score(docs: DataFrame, model: AttentionModel | None, text: str = "text") -> DataFrame:
    """`docs` with `score`, the probability of good quality from the attention-weighted passages.

    Every passage of the whole text is encoded; null and empty texts are one empty passage. Without
    a model every score is 0.5. A column called score is replaced, others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in parts:
            out = np.full(len(column), 0.5)
            if m is not None:
                for x, doc, i, j in _passages(column):
                    out[i:j] = m.parts(x.astype(float), doc, j - i)["p"]
            yield pa.array(out)

    rest = without(docs, "score")
    name = free_name(rest, "_s")
    scored = rest.withColumn(name, F.arrow_udf(run, "double")(F.col(f"`{text}`")))
    return scored.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(name).alias("score"))
