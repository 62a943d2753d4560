"""Term counting: the pruned bigrams against a plain count, one reading of the texts, the packed gradient pass."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticewing.models import classify, embed, linear, tfidf
from noticewing.plans import workflows


def plain_vocabulary(texts, max_terms, min_df):
    df, total = Counter(), Counter()
    for t in texts:
        u = (t or "").split()
        terms = u + [f"{a} {b}" for a, b in zip(u, u[1:])]
        total.update(terms)
        df.update(set(terms))
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:max_terms]
    return [(t, df[t], total[t]) for t in sorted(kept)]


@pytest.mark.parametrize("max_terms", [7, 25, 60, 5000])
def test_vocabulary_with_many_ties_equals_a_plain_count(spark, monkeypatch, max_terms):
    rng = random.Random(max_terms)
    # frequent pairs of words that always go together, so that bigrams tie with their words
    texts = [" ".join(rng.choice(["aa zz", "bb cc dd", "mm", "nn oo", "zz yy"]) for _ in range(rng.randrange(9))) for _ in range(40)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = plain_vocabulary(texts, max_terms, 2)
    for ties in (tfidf.TIES, 0):  # 0: no list of second words
        monkeypatch.setattr(tfidf, "TIES", ties)
        got = [(r["term"], r["df"], r["total"]) for r in tfidf.vocabulary(frame, max_terms=max_terms).orderBy("idx").collect()]
        assert got == want


def test_pairs_of_rare_words_are_not_counted(spark):
    rare = [f"once{i}x twice{i // 2}y" for i in range(200)]
    frame = spark.createDataFrame([(t,) for t in rare + ["often seen"] * 5], "text string").select(tfidf.words_of(F.col("text")).alias(tfidf.WORDS))
    terms = {r["term"] for r in tfidf.counted_terms(frame, 2, 2).collect()}
    assert "often seen" in terms and not any(" " in t for t in terms - {"often seen"})


def test_a_fit_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    levels = ["HIGH", "MEDIUM", "LOW", "INFO"]
    rows = spark.createDataFrame([(f"n{i}", levels[i % 4], f"word{i % 4} and word{i % 3}") for i in range(24)], "id string, criticality string, text string")
    classify.fit_lr(rows.withColumn("text", counted.asNondeterministic()("text")), max_iter=2)
    assert read.value == 24


def test_blocks_of_any_size_give_the_same_gradient(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(4)), int(i % 3), sorted(rng.choice(300, n, replace=False).tolist())) for i, n in enumerate(rng.integers(0, 40, 50))]
    rows = spark.createDataFrame([(y, f, t, [1 + (k % 70) * 1000 if i == 7 else 1 + k % 3 for k in t]) for i, (y, f, t) in enumerate(data)], "y int, fold int, terms array<int>, tf array<int>")
    some = [linear.Problem(np.arange(300)[f::2], rng.random(len(range(f, 300, 2))) + 0.5, np.array([1.0, 2.0, 0.5, 1.5]), 50.0, f) for f in range(2)]
    points = {j: rng.normal(size=4 * (len(p.place) + 1)) for j, p in enumerate(some)}
    monkeypatch.setattr(linear, "BLOCK", 64)
    found = linear.gradients(rows, some, 300, points)
    for j, p in enumerate(some):
        loss, slope, b = 0.0, np.zeros((4, len(p.place))), points[j][:-4].reshape(4, -1)
        bias = np.zeros(4)
        for r in rows.collect():
            x = np.zeros(300)
            x[r["terms"]] = (1 + np.log(r["tf"])) * p.shared_idf(300)[r["terms"]] if r["terms"] else 0
            x = (x / (np.linalg.norm(x) or 1))[p.place]
            m = b @ x + points[j][-4:]
            q = np.exp(m - m.max())
            q /= q.sum()
            w = 0.0 if r["fold"] == p.left_out else p.weight[r["y"]]
            loss -= w * np.log(q[r["y"]])
            q[r["y"]] -= 1
            slope += w * np.outer(q, x)
            bias += w * q
        assert found[j][0] == pytest.approx(loss / 50) and np.allclose(found[j][1], np.concatenate((slope.ravel(), bias)) / 50)


def test_training_works_out_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    levels = ["HIGH", "MEDIUM", "LOW", "INFO"]
    rows = spark.createDataFrame([(f"n{i}", levels[i % 4], f"word{i % 4} and word{i % 3}", "auto") for i in range(40)], "id string, criticality string, text string, reason string")
    workflows.train_all(rows.withColumn("text", counted.asNondeterministic()("text")), embed.hashing_encoder(8), trees=3)
    assert read.value == 40
