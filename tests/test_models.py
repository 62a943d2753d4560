import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticewing.functions import text as tx
from noticewing.models import classify, embed, iforest, tfidf
from noticewing.operators import lookup
from noticewing.plans import workflows
from noticewing.sources import models as store

WORDS = {
    "HIGH": "rwy closed ils unserviceable tfr airspace", "MEDIUM": "twy closed obstacle crane light approach",
    "LOW": "apron light mowing ramp marking", "INFO": "office phone document service note",
}


@pytest.fixture(scope="module")
def labeled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        level = ("LOW", "LOW", "MEDIUM", "HIGH", "INFO")[i % 5]
        text = " ".join(rng.choice(WORDS[level].split()) for _ in range(8)) + f" ref{i % 11}"
        rows.append((f"n{i}", "R1", "KOKC", "KJFK", f"K{i % 7}", "DOM", None, text, level, 10, "auto"))
    from noticewing.sources.labels import LABELED

    return spark.createDataFrame(rows, LABELED)


@pytest.fixture(scope="module")
def trained(labeled):
    return workflows.train_all(labeled, embed.hashing_encoder(32), trees=10)


def test_tfidf_weights_by_hand(spark):
    texts = {"a": "Rwy RWY closed Café", "b": "rwy open cafe", "c": "x y", "d": None}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    vocab = tfidf.vocabulary(df)
    assert [(r["term"], r["df"], r["total"]) for r in vocab.orderBy("idx").collect()] == [("cafe", 2, 2), ("rwy", 2, 3)]
    idf = math.log(5 / 3) + 1
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf.weights(df, vocab).collect()}
    w = [idf * (1 + math.log(2)), idf]
    assert got[("a", "rwy")] == pytest.approx(w[0] / math.hypot(*w)) and got[("b", "cafe")] == pytest.approx(1 / math.sqrt(2))
    model = tfidf.TfidfModel.fit(df)
    vectors = {r["id"]: r["features"] for r in model.transform(df).collect()}
    assert len(vectors) == 4 and vectors["c"].numNonzeros() == 0 and vectors["a"][1] == pytest.approx(got[("a", "rwy")])


def test_linear_scoring_equals_the_vector_model(spark, labeled):
    train = labeled.select("id", "text", "criticality")
    model = classify.fit_lr(train)
    matrix, bias = np.array(model.coefficients), np.array(model.intercepts)
    features = {r["id"]: r["features"].toArray() for r in model.vocab.transform(train).collect()}
    for r in model.transform(train).collect():
        m = matrix @ features[r["id"]] + bias
        p = np.exp(m - m.max()) / np.exp(m - m.max()).sum()
        assert r["criticality"] == classify.LEVELS[int(p.argmax())] and r["confidence"] == pytest.approx(float(p.max()))
    terms = classify.top_terms(model, spark, k=3).where("criticality = 'HIGH'").collect()
    assert len(terms) == 3 and all(set(t["term"].split()) & set(WORDS["HIGH"].split()) for t in terms)


def test_training_finds_the_classes(trained):
    models, scores = trained
    for r in scores.collect():
        assert r["macro_f1"] > 80, r
    assert scores.count() == 2


def test_cross_validation(labeled):
    df = labeled.select("id", "text", "criticality")
    row = classify.cv_scores(df, lambda part: classify.predict_with(classify.fit_lr(part, max_iter=20)), "lr", folds=2).first()
    assert row["model"] == "lr" and 80 < row["macro_f1_mean"] <= 100 and row["macro_f1_std"] >= 0


def test_models_on_disk(spark, trained, tmp_path, labeled):
    models, _ = trained
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError, match="linear.*forest.*isolation"):
        store.load_models(spark, path)
    store.save_models(models, spark, path)
    again = store.load_models(spark, path)
    encoder = embed.hashing_encoder(32)
    rows = labeled.select("id", "text", F.monotonically_increasing_id().alias("pos")).where("pos is not null")
    rows = rows.unionByName(spark.createDataFrame([("x", "RWY Canceled", 10**12)], "id string, text string, pos long"))
    a = workflows.score_batch(rows, models, encoder).orderBy("notice_id").collect()
    b = workflows.score_batch(rows, again, encoder).orderBy("notice_id").collect()
    assert a == b and len(a) == 160 and list(a[0].asDict()) == ["pos", *workflows.RESULT]
    assert all(r["final_criticality"] == r["rf_criticality"] for r in a)
    flagged = sum(r["is_anomaly"] for r in a)
    assert 8 <= flagged <= 20


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    points = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(999, [9.0] * 8)]
    df = spark.createDataFrame(points, "id long, embedding array<float>")
    model = iforest.IsolationForestModel.fit(df, trees=60)
    again = iforest.IsolationForestModel.fit(df.repartition(5), trees=60)
    pd.testing.assert_frame_equal(model.nodes, again.nodes)
    scored = model.transform(df).toPandas().set_index("id")["anomaly_score"]
    assert scored.idxmax() == 999 and model.psi == 256 and model.offset < 0
    raw = scored - model.offset
    assert raw.between(0, 1).all()
    # the offset puts the 95th percentile of the training scores at zero
    assert np.quantile(scored, 0.95) == pytest.approx(0.0, abs=1e-12)
    sizes = model.nodes[model.nodes["feature"] < 0].groupby("tree")["size"].sum()
    assert (sizes == 256).all() and model.nodes["depth"].max() <= 8
    assert iforest.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_embedding_store_and_pluggable_encoder(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", None)], "id string, text string")
    kept = spark.createDataFrame([("a", [1.0, 2.0]), ("z", [0.0, 0.0])], "id string, embedding array<float>")

    def load():
        return lambda texts: [[float(len(t)), 0.0] for t in texts]

    got = {r["id"]: r["embedding"] for r in embed.embed(df, embed.batch_encoder(load), kept).collect()}
    assert got == {"a": [1.0, 2.0], "b": [5.0, 0.0], "c": [0.0, 0.0]}
    hashed = {r["id"]: r["embedding"] for r in embed.embed(df, embed.hashing_encoder(16)).collect()}
    assert all(len(v) == 16 for v in hashed.values()) and sum(x * x for x in hashed["a"]) == pytest.approx(1.0, abs=1e-6)


def test_route_brief_end_to_end(spark, trained):
    models, _ = trained
    airports = spark.createDataFrame(
        [(0, "JFK", "KJFK", 40.6398, -73.7789, "United States", "America/New_York"), (1, "BOS", "KBOS", 42.3643, -71.0052, "United States", None),
         (2, "HNL", "PHNL", 21.32, -157.92, "United States", "Pacific/Honolulu")],
        "pos int, iata string, icao string, lat double, lon double, country string, tz_name string",
    )
    routes = spark.createDataFrame([("JFK_BOS", "JFK", "KBOS"), ("JFK_HNL", "JFK", "HNL")], "route_id string, departure string, destination string")
    notices = spark.createDataFrame(
        [(1, "near1", 40.7, -73.7, "rwy closed", "R", "N", "MIL", "R", "A"), (2, "near2", 42.3, -71.0, "office note", "C", "K", "DOM", None, None),
         (3, "far", 10.0, 10.0, "rwy closed", "N", "N", "DOM", None, None)],
        "pos long, id string, lat double, lon double, text string, type string, purpose string, classification string, series string, scope string",
    )
    ranked, rejected = workflows.route_notices(routes, airports, notices)
    rows = ranked.orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in rows] == [("near1", 1), ("near2", 2)]
    assert [r["route_id"] for r in rejected.collect()] == ["JFK_HNL"]
    lines = [r["line"] for r in workflows.brief_routes(ranked, models, embed.hashing_encoder(32), routes, "2025-01-01 00:00Z").orderBy("section", "pos", "line_no").collect()]
    assert lines[1] == "  Briefing JFK -> KBOS, made 2025-01-01 00:00Z UTC" and "  Notices rated: 2" in lines


def test_labelled_set_end_to_end(spark):
    def blocks(ids):
        return spark.createDataFrame([(i, k, "R1", "A", "B", "KX", "Classification.DOM", "Q", f"t {k}") for i, k in enumerate(ids)],
                                     "seq int, id string, route string, departure string, destination string, icao_location string, classification string, selection_code string, text string")

    kept = spark.createDataFrame([("n1", "LOW", 20, "old")], "notice_id string, criticality string, score int, reason string")

    def ask(todo):
        assert {r["id"] for r in todo.select("id").collect()} == {"n2", "n3"}
        return todo.select(F.col("id").alias("notice_id"), F.lit(1).alias("attempt"), F.when(F.col("id") == "n3", 400).otherwise(200).alias("status"),
                           F.lit('{"criticality":"HIGH","score":80}').alias("reply"))

    labeled, known = workflows.build_labeled([blocks(["n1", "n2"]), blocks(["n2", "n3"])], kept, ask, ["seq"])
    got = {r["id"]: (r["criticality"], r["classification"], r["reason"]) for r in labeled.collect()}
    assert got == {"n1": ("LOW", "DOM", "old"), "n2": ("HIGH", "DOM", ""), "n3": ("INFO", "DOM", "LABELING_FAILED: HTTP 400")}
    assert {r["notice_id"] for r in known.collect()} == {"n1", "n2"}


def test_rare_airports(spark):
    everything = spark.createDataFrame([("KA",)] * 6 + [("KB",)] * 2 + [(None,)] * 9, "icao_location string")
    top = spark.createDataFrame([("1", "KA"), ("2", "KB"), ("3", None)], "id string, icao_location string")
    flagged = lookup.rare_airports(top, everything)
    assert {r["id"]: (r["airport_total"], r["likely_rare"]) for r in flagged.collect()} == {"1": (6, False), "2": (2, True), "3": (0, True)}
    assert lookup.rare_share(flagged).first()["rare_driven"] == 2


def test_level_order(spark):
    df = spark.createDataFrame([("INFO",), ("HIGH",), ("odd",), ("LOW",)], "c string")
    assert [r[0] for r in df.orderBy(tx.level_order(F.col("c"))).collect()] == ["odd", "HIGH", "LOW", "INFO"]
