"""Toxicity: cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import batches_of, free_name, text_bytes, uniform, without, word_hashes, word_spans

#: labelled documents the model is fitted on at most, per label
SAMPLE_PER_LABEL = 5000
#: grades 1 to GRADES - 1 divide the toxic documents; grade 0 is not toxic
GRADES = 4
#: words in fewer documents of the sample are no features
MIN_DOCS = 4

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Blocks of documents as (row, word hash, count), sorted by both, with the block's rows."""
    data, rows = text_bytes(column)
    for i, j in batches_of(rows):
        at = rows[i : j + 1]
        part = _LOWER[data[at[0] : at[-1]]]
        starts, ends, first = word_spans(part, at - at[0], _BREAK)
        words = word_hashes(part, starts, ends)
        row = np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((words, row))
        row, words = row[order], words[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (words[1:] != words[:-1])
        edge = np.flatnonzero(new)
        yield row[edge], words[edge], np.diff(np.append(edge, len(row))), i, j


@F.arrow_udf(T.StructType().add("words", T.ArrayType(T.LongType())).add("counts", T.ArrayType(T.IntegerType())))
def _bag(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in text:
        words, counts, sizes = [], [], []
        for row, word, count, i, j in _bags(column):
            words.append(word.view(np.int64))
            counts.append(count.astype(np.int32))
            sizes.append(np.bincount(row, minlength=j - i))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        offsets = np.concatenate(([0], np.cumsum(cat(sizes, np.int64)))).astype(np.int32)
        make = lambda v, t: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v, type=t))
        yield pa.StructArray.from_arrays([make(cat(words, np.int64), pa.int64()), make(cat(counts, np.int32), pa.int32())], ["words", "counts"])


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(cuts[k] - weights . log1p(counts)): one weight a word for all cuts."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    cuts: np.ndarray  # increasing

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))

    def rejects(self, probability: Column) -> Column:
        """Whether a toxic probability speaks against a text: a half or more, and more than a text without known words has."""
        return (probability >= 0.5) & (probability > float(self.at_least(np.zeros(1))[0, 0]))


def _grades(row: np.ndarray, col: np.ndarray, count: np.ndarray, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Severity grades for 0/1 labels: toxic documents in equal parts by the share of marked words.

    Marked are words at least eight times likelier in toxic documents of the sample than in others.
    """
    inside = np.bincount(col, weights=toxic[row], minlength=n_words)
    outside = np.bincount(col, weights=1.0 - toxic[row], minlength=n_words)
    odds = (inside + 0.5) / (toxic.sum() + 1) / ((outside + 0.5) / ((1 - toxic).sum() + 1))
    marked = (odds >= 8) & (inside >= MIN_DOCS)
    share = np.bincount(row, weights=count * marked[col], minlength=len(toxic)) / np.maximum(np.bincount(row, weights=count, minlength=len(toxic)), 1)
    grades = np.zeros(len(toxic), dtype=np.int64)
    bad = np.flatnonzero(toxic > 0)
    if len(bad):
        place = np.argsort(np.argsort(share[bad], kind="stable"), kind="stable")
        grades[bad] = 1 + place * (GRADES - 1) // len(bad)
    return grades


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_words: int, weight: np.ndarray | None = None, *, prior: float = 1.0, steps: int = 250, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the largest posterior: cumulative-link likelihood, weights N(0, prior^2) (Adam).

    `weight` says how many documents each one stands for; only the proportions count.
    """
    n, k = len(grade), GRADES - 1
    weight = np.ones(n) if weight is None else weight * (n / weight.sum())
    l2 = 1 / (n * prior**2)
    # Grades of a few in a million are found too, so the bound is far out.
    share = np.clip(np.array([weight[grade <= c].sum() / n for c in range(k)]), 1e-9, 1 - 1e-9)
    first = np.log(share / (1 - share))
    theta = np.concatenate((np.zeros(n_words), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_words], np.exp(theta[n_words + 1 :])
        cuts = theta[n_words] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row, weights=value * w[col], minlength=n)
        upto = 1 / (1 + np.exp(np.clip(score[:, None] - cuts, -40, 40)))
        slope = upto * (1 - upto)
        edge = np.concatenate((np.zeros((n, 1)), upto, np.ones((n, 1))), axis=1)
        tilt = np.concatenate((np.zeros((n, 1)), slope, np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        p = np.maximum(edge[at, grade + 1] - edge[at, grade], 1e-9)
        high, low = weight * tilt[at, grade + 1] / p, weight * tilt[at, grade] / p
        d_score = (high - low) / n  # of the negative log likelihood
        d_cut = np.array([-(high[grade == c].sum() - low[grade == c + 1].sum()) / n for c in range(k)])
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, weights=value * d_score[row], minlength=n_words) + l2 * w, [tail[0]], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[n_words + 1 :])
    return theta[:n_words], theta[n_words] + np.concatenate(([0.0], np.cumsum(gaps)))


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = SAMPLE_PER_LABEL, key: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Model from a bounded sample: the `per_label` labelled documents of each label with the smallest key hashes.

    Labels other than 0 and 1, null keys and labels without a document are left out; a key labelled
    twice is toxic if any row says so, and of several texts with one key the one with the least hash counts. Sampled documents weigh as many labels as they stand for, so
    the shares of the labels are those of all rows. Without a toxic and a clean document, or without a
    word in MIN_DOCS documents, every severity is 0.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    stands_for = {int(r[0]): max(1.0, r[1] / per_label) for r in marks.groupBy("_y").count().collect()}
    picked = None
    for y in (0, 1):
        part = marks.where(F.col("_y") == y).orderBy(uniform("_k"), "_k").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    # At most two samples of key and label: their size does not grow with the data.
    got = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(picked), "_k")
    got = got.groupBy("_k", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t")).select("_y", _bag("_t").alias("_b")).select("_y", "_b.*").toArrow()
    toxic = got["_y"].to_numpy().astype(float)
    bags, counted = got["words"].combine_chunks(), got["counts"].combine_chunks()
    if not len(toxic) or toxic.min() == toxic.max():
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0))
    sizes = np.diff(bags.offsets.to_numpy())
    row = np.repeat(np.arange(len(toxic)), sizes)
    words, col, seen = np.unique(bags.flatten().to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    count = counted.flatten().to_numpy().astype(float)
    often = seen >= MIN_DOCS
    place = np.cumsum(often) - 1
    kept = often[col]
    row, col, count, words = row[kept], place[col[kept]], count[kept], words[often]
    if not len(words):
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0))
    grade = _grades(row, col, count, toxic, len(words))
    weight = np.where(toxic > 0, stands_for[1], stands_for[0])
    weights, cuts = fit_ordinal(row, col, np.log1p(count), grade, len(words), weight)
    return OrdinalModel(words, weights, cuts)


def severity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """`docs` with `severity` (expected grade, 0 to 3) and `toxic_probability` (of grade 1 or more).

    Whole texts are read. Null texts count as empty; texts without known words get the model's base
    rate. Columns with these names are replaced, others kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in parts:
            score = np.zeros(len(column))
            for row, word, count, i, j in _bags(column):
                if len(m.words):
                    at = np.minimum(np.searchsorted(m.words, word), len(m.words) - 1)
                    value = np.where(m.words[at] == word, m.weights[at], 0.0) * np.log1p(count)
                    score[i:j] = np.bincount(row, weights=value, minlength=j - i)
            p = m.at_least(score)
            yield pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0])], ["severity", "toxic_probability"])

    add = F.arrow_udf(run, "struct<severity:double,toxic_probability:double>")
    rest = without(docs, "severity", "toxic_probability")
    name = free_name(rest, "_s")
    return rest.withColumn(name, add(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in rest.columns], f"{name}.*")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that the model does not reject (`OrdinalModel.rejects`), with their own columns.

    A text without known words says nothing and stays, whatever share of the labels is toxic.
    """
    model = fit(docs, labels)
    rated = severity(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text")), model)
    return rated.where(~model.rejects(F.col("toxic_probability"))).select("_row.*")
