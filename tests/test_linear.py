"""The linear solver: optimum, folds side by side, vocabularies from one count, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticewing.models import classify, linear, split, tfidf


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    words = {"HIGH": "closed runway danger", "MEDIUM": "taxiway works partly", "LOW": "lights crane mast", "INFO": "office chart notice"}
    data = []
    for i in range(240):
        level = ["HIGH", "MEDIUM", "LOW", "LOW", "INFO"][i % 5]
        text = " ".join(rng.choice(words[level].split() + ["the", "of", "at", "field"], size=12)) + f" {rng.choice(list(words))}"
        data.append((f"n{i}", level, text))
    return spark.createDataFrame(data + [("e", "LOW", ""), ("n", "HIGH", None), ("u", "UNKNOWN", "closed runway")], "id string, criticality string, text string").repartition(5)


def test_lbfgs_on_a_badly_scaled_bowl():
    scale = np.array([1.0, 100.0, 1e4])
    run = linear.lbfgs(np.array([3.0, -2.0, 1.0]), 200, 1e-8)
    x, n = next(run), 0
    try:
        while True:
            n += 1
            x = run.send((float((scale * (x - 1) ** 2).sum()), 2 * scale * (x - 1)))
    except StopIteration as end:
        x = end.value
    assert np.abs(x - 1).max() < 1e-7 and n < 100


def test_fit_is_the_optimum(rows):
    """At the fitted point the gradient vanishes by finite differences of an objective written out here."""
    train = rows.where("criticality != 'UNKNOWN' AND text IS NOT NULL")
    model = classify.fit_lr(train, tol=1e-7)
    data = train.collect()
    vocab = {r[0]: (r[1], r[4]) for r in model.vocab.rows}
    import re
    from collections import Counter

    x, y = np.zeros((len(data), len(vocab))), np.array([classify.LEVELS.index(r["criticality"]) for r in data])
    for i, r in enumerate(data):
        u = re.findall(r"\w{2,}", r["text"].lower())
        for t, n in Counter(u + [f"{a} {b}" for a, b in zip(u, u[1:])]).items():
            if t in vocab:
                x[i, vocab[t][0]] = (1 + np.log(n)) * vocab[t][1]
        x[i] /= np.linalg.norm(x[i]) or 1
    weight = len(y) / (4 * np.bincount(y))[y]

    def objective(b, c):
        m = x @ b.T + c
        m -= m.max(1, keepdims=True)
        return (weight * (np.log(np.exp(m).sum(1)) - m[np.arange(len(y)), y])).sum() / len(y) + (b**2).sum() / (2 * len(y))

    b, c = np.array(model.coefficients), np.array(model.intercepts)
    rng = np.random.default_rng(1)
    for _ in range(6):
        d, e = rng.normal(size=b.shape), rng.normal(size=4)
        assert abs(objective(b + 1e-4 * d, c + 1e-4 * e) - objective(b - 1e-4 * d, c - 1e-4 * e)) / 2e-4 < 1e-4
    scored = {r["id"]: r for r in model.transform(train).collect()}
    m = x @ b.T + c
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for i, r in enumerate(data):
        assert scored[r["id"]]["criticality"] == classify.LEVELS[int(p[i].argmax())] and scored[r["id"]]["confidence"] == pytest.approx(p[i].max())


def test_vocabularies_from_one_count(rows):
    parts = split.stratified_folds(rows, "criticality", "id", 3, 42).cache()
    got = linear.fold_vocabularies(parts, 3)
    for f in range(3):
        alone = tfidf.TfidfModel.fit(parts.where(F.col("fold") != f)).rows
        assert [(t, round(i, 12)) for t, i in got[f]] == [(r[0], round(r[4], 12)) for r in alone]


def test_folds_side_by_side_equal_one_after_the_other(rows):
    parts = split.stratified_folds(rows.where("text IS NOT NULL AND criticality != 'UNKNOWN'"), "criticality", "id", 3, 42).cache()
    got = {r["id"]: (r["fold"], r["y_pred"]) for r in linear.cross_predict(parts, 3, tol=1e-7).collect()}
    assert len(got) == 241
    for f in range(3):
        model = classify.fit_lr(parts.where(F.col("fold") != f), tol=1e-7)
        alone = {r["id"]: (f, r["criticality"]) for r in model.transform(parts.where(F.col("fold") == f)).collect()}
        assert alone == {k: v for k, v in got.items() if v[0] == f}
    one = classify.cv_scores_lr(rows.where("text IS NOT NULL"), folds=3).first()
    two = classify.cv_scores(rows.where("text IS NOT NULL"), lambda part: classify.predict_with(classify.fit_lr(part)), folds=3).first()
    assert one["macro_f1_mean"] == pytest.approx(two["macro_f1_mean"], abs=0.8)


def test_many_tasks_and_missing_levels(spark, rows):
    some = rows.where("criticality IN ('HIGH', 'LOW')")
    model = classify.fit_lr(some.repartition(40))
    assert model.intercepts[1] == model.intercepts[3] == float("-inf")
    got = {r["id"]: r for r in model.transform(rows).collect()}
    assert {r["criticality"] for r in got.values()} <= {"HIGH", "LOW"} and got["n"]["criticality"] is not None
    assert model.transform(rows.limit(0)).count() == 0
    spread = classify.storage.written(linear.encoded(linear.numbered(rows, "criticality").select("y", F.lit(0).alias("fold"), "text"), [r[0] for r in model.vocab.rows]))
    weight, n = linear.class_weights({0: 49, 1: 48, 2: 97, 3: 48})
    problem = linear.Problem(np.arange(len(model.vocab.rows)), np.array([r[4] for r in model.vocab.rows]), weight, n)
    x = {0: np.random.default_rng(2).normal(size=4 * (len(model.vocab.rows) + 1))}
    few, many = (linear.gradients(spread.repartition(k), [problem], len(model.vocab.rows), x)[0] for k in (1, 40))
    assert few[0] == pytest.approx(many[0]) and np.allclose(few[1], many[1])
