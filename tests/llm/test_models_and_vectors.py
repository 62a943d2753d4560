"""Toxicity, quality and vector operators: held-out accuracy, brute force, odd inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticewing.llm import graph, hyperplanes, postings, quality, severity

from . import cases


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(rng.randrange(20, 150))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                text[rng.randrange(len(text))] = rng.choice(["vile", "rotten", "nasty"])
        if bad:
            text = [w.upper() + rng.choice(["!!", "$$$", "###"]) for w in text]
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "x " * 30000)]
    labels += [(None, 1, 1), (5000, 1, 0), (1000, None, None), (1001, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_k": F.lit(1), "severity": F.lit("x"), "score": F.lit("y")})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = severity.fit(docs, labels)
    assert (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in severity.severity(docs, model).collect()}
    assert len(got) == 604
    right = sum((got[i]["toxic_probability"] >= 0.5) == (i % 5 == 0) for i in range(0, 600, 2))  # none of these has a label
    assert right >= 288
    assert all(0 <= r["severity"] <= 3 for r in got.values()) and got[1000]["severity"] == got[1001]["severity"]
    clean = severity.clean(docs, labels)
    assert clean.columns == docs.columns and 470 <= clean.count() <= 500
    assert severity.severity(docs.limit(0), model).count() == 0
    nobody = severity.fit(docs, labels.limit(0))
    assert severity.severity(docs, nobody).agg(F.max("severity")).first()[0] < 1e-9


def test_more_marked_words_are_graded_worse(spark, labelled):
    docs, labels = labelled
    model = severity.fit(docs, labels)
    rows = [(k, " ".join(["word1 word2 word3"] * 10 + ["vile"] * k)) for k in (0, 2, 12)]
    got = [r["severity"] for r in severity.severity(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got[0] < got[1] < got[2]


def test_a_smaller_sample_keeps_the_rejection_rate(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        text = [f"word{rng.randrange(40)}" for _ in range(30)]
        vile, sure = i % 4 == 0, i % 20 == 1
        text[:1] = ["vile"] if vile else ["rotten"] if sure else text[:1]
        rows.append((i, " ".join(text)))
        labels.append((i, int(sure or rng.random() < (0.3 if vile else 0.01))))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rates = []
    for per_label in (5000, 300):
        rated = severity.severity(docs, severity.fit(docs, marks, per_label=per_label))
        rates.append(rated.agg(F.avg((F.col("toxic_probability") >= 0.5).cast("int"))).first()[0])
    assert 0.04 < rates[0] < 0.12 and abs(rates[0] - rates[1]) < 0.03


def test_quality(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == 604 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.7) == (i % 7 != 0) for i in range(0, 600, 3)) >= 196
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs.limit(3), None).collect()} == {0.5}


def test_attention_gradients_learn_the_decisive_passage():
    rng = np.random.default_rng(0)
    doc = np.repeat(np.arange(200), 5)
    x = rng.normal(0, 0.1, (1000, quality.WIDTH)).astype(np.float32)
    y = (np.arange(200) % 2).astype(float)
    x[np.flatnonzero(y == 1) * 5 + 2, 0] += 3
    model = quality.fit_attention(x, doc, y, np.ones(200), epochs=15)
    p = model.parts(x.astype(float), doc, 200)["p"]
    assert ((p > 0.5) == (y == 1)).mean() > 0.97


def vectors(spark, n=400, width=16):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = base[i % 12] + rng.normal(0, 0.08, width)
        rows.append((i, [float(np.float32(c)) for c in v], i % 12 % 3))
    rows += [(1000 + k, rows[0][1], 0) for k in range(60)]  # one large group of equal vectors
    rows += [(2000, None, 0), (2001, [0.0] * width, 0), (2002, [float("nan")] * width, 0), (2003, [None] + [1.0] * (width - 1), 0), (2004, [], 0),
             (2005, rows[0][1], None), (2020, [1.0, 2.0], 0), (2021, [float("inf")] + [1.0] * (width - 1), 0), (2040, [2.0, 4.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit("x"), "_key": F.lit(1)})


def is_usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_near_vectors(spark):
    rows, df = vectors(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hyperplanes.near_vectors(df, 0.98).collect()}
    parent = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fine = [(i, np.array(v, dtype=np.float32).astype(float), y) for i, v, y in rows if is_usable(v) and y is not None]
    for k, (i, v, y) in enumerate(fine):
        for j, w, z in fine[:k]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: (links[i], find(i), find(i) == i) for i in parent}
    assert hyperplanes.near_vectors(df.limit(0), 0.98).count() == 0
    assert hyperplanes.near_vectors(df.where("vec_id = 2001"), 0.98).collect()[0]["n_links"] == 0


def test_nearest(spark):
    rows, df = vectors(spark)
    got = {}
    for r in postings.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if is_usable(v)]
    hits = total = 0
    assert set(got) == {i for i, _ in fine if i % 20 == 0}
    for i, v in fine:
        if i % 20 == 0:
            best = sorted(((-float((v * w).sum()), j) for j, w in fine if j != i and len(w) == len(v)))[:20]
            mine = sorted(got[i])
            assert [m[0] for m in mine] == list(range(1, len(best) + 1))
            hits += len({j for _, j in best} & {m[1] for m in mine})
            total += len(best)
            assert all(abs(m[2] - float((v * dict(fine)[m[1]]).sum())) < 1e-9 for m in mine)
    assert hits / total >= 0.98
    assert postings.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def _shape(name, n, width=32):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if name == "lengths":
        x *= rng.lognormal(0, 0.5, size=n)[:, None]
    if name == "noisy":
        centres = rng.normal(size=(n // 100, width))
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width))
    return x


@pytest.mark.parametrize("name, n", [("unit", 20_000), ("lengths", 20_000), ("noisy", 60_000)])
def test_recall_at_any_shape(spark, monkeypatch, name, n):
    x, sizes = _shape(name, n), {}
    measured = postings._measured

    def watched(own, posted, asking, graph, *rest):
        sizes["held"] = postings._sizes(posted, len(graph.centroids))
        return measured(own, posted, asking, graph, *rest)

    monkeypatch.setattr(postings, "_measured", watched)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": list(x)}))
    got = postings.nearest(df, F.col("vec_id") % 100 == 0, 20).toPandas()
    asked = np.arange(0, n, 100)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-score, 20, axis=1)[:, :20]
    found = set(zip(got["query_id"], got["vec_id"]))
    assert sum((int(q), int(v)) in found for q, row in zip(asked, true) for v in row) >= 0.95 * true.size
    assert (got.groupby("query_id").size() == 20).all()
    held = sizes["held"][sizes["held"] > 0]
    assert held.max() <= 2 * held.mean()


def test_texts_without_evidence_are_kept(spark, labelled):
    """Most labels toxic: empty, null and unknown texts stay, toxic ones go; a tie without features rejects nothing."""
    docs, labels = labelled
    more = labels.where("toxic = 1").unionByName(labels.where("toxic = 0").limit(int(labels.where("toxic = 1").count() / 1.5)))
    assert more.agg(F.avg("toxic")).first()[0] > 0.55
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, " \n "), (5003, "zzzz qqqq never seen")], "doc_id long, text string")
    kept = {r["doc_id"] for r in severity.clean(docs.select("doc_id", "text").unionByName(extra), more).collect()}
    assert {5000, 5001, 5002, 5003} <= kept
    assert sum(i in kept for i in range(0, 600, 10)) < 12 and sum(i in kept for i in range(2, 600, 10)) > 54
    two = spark.createDataFrame([(1, "some words"), (2, "other text"), (3, None), (3, "x")], "doc_id long, text string")
    tie = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert severity.clean(two, tie).count() == 4


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (60, 59), (300, 301), (301, 302), (302, 300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + k: 100 for k in range(40)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = cases.documents()
    folder = str(tmp_path)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (14, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == docs.columns, name
        step.write.parquet(f"{folder}/{name}")
        step = spark.read.parquet(f"{folder}/{name}")
    out = corpus_pipeline.run(spark, folder)
    assert out.select("doc_id").distinct().count() == step.select("doc_id").distinct().count() > 20
