import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticewing.models import split
from noticewing.operators import metrics, profile
from noticewing.plans import order as od


@pytest.mark.parametrize("n, kind", [(1, "even"), (2, "even"), (3, "even"), (997, "even"), (800, "hot"), (500, "spike")])
def test_exact_quantiles(spark, n, kind):
    rng = random.Random(n)
    values = [rng.gauss(0, 1) for _ in range(n)]
    if kind == "hot":  # a third of all rows share one value
        values = [0.25 if i % 3 == 0 else v for i, v in enumerate(values)]
    if kind == "spike":
        values = [1e-9 * v for v in values[:-1]] + [1e6]
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {r["prob"]: r["quantile"] for r in od.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-18)


def test_grouped_position(spark, monkeypatch):
    monkeypatch.setattr(od, "POSITION_WIDTH", 16)
    rows = [("hot" if i % 3 else "cold", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, pos long").repartition(4)
    got = od.grouped_position(df, ["g"], [od.position_bucket(F.col("pos"))], [F.asc("pos")]).collect()
    want = {}
    for g in ("hot", "cold"):
        for i, (_, pos) in enumerate([r for r in rows if r[0] == g], start=1):
            want[(g, pos)] = i
    assert {(r["g"], r["pos"]): r["position"] for r in got} == want


def test_split_is_exact_disjoint_and_stable(spark):
    levels = ["LOW"] * 401 + ["HIGH"] * 53 + ["MEDIUM"] * 7 + ["INFO"] * 1
    df = spark.createDataFrame([(f"n{i}", lv) for i, lv in enumerate(levels)], "id string, criticality string")
    parts = {r["id"]: r["is_test"] for r in split.stratified_split(df).collect()}
    again = {r["id"]: r["is_test"] for r in split.stratified_split(df.repartition(3)).collect()}
    assert parts == again and len(parts) == len(levels)
    assert sum(parts.values()) == -(-len(levels) // 5)
    low = [parts[f"n{i}"] for i, lv in enumerate(levels) if lv == "LOW"]
    assert abs(sum(low) - 401 * 0.2) < 1
    folds = split.stratified_folds(df, folds=5).groupBy("criticality", "fold").count().where("criticality = 'LOW'").collect()
    assert {r["count"] for r in folds} <= {80, 81} and len(folds) == 5


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    pairs = [(rng.choice(["HIGH", "MEDIUM", "LOW"]), rng.choice(["HIGH", "LOW"])) for _ in range(200)]
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    f1 = {}
    for lv in ("HIGH", "MEDIUM", "LOW", "INFO"):
        tp = sum(t == p == lv for t, p in pairs)
        fp, fn = sum(p == lv != t for t, p in pairs), sum(t == lv != p for t, p in pairs)
        f1[lv] = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    row = metrics.model_metrics(df, "m", dp=6).first()
    assert row["accuracy"] == pytest.approx(100 * sum(t == p for t, p in pairs) / 200)
    assert row["macro_f1"] == pytest.approx(25 * sum(f1.values()), abs=1e-5)
    assert row["high_f1"] == pytest.approx(100 * f1["HIGH"], abs=1e-5)
    matrix = {r["y_true"]: r.asDict() for r in metrics.confusion(df).collect()}
    assert matrix["INFO"] == {"y_true": "INFO", "HIGH": 0, "MEDIUM": 0, "LOW": 0, "INFO": 0}
    assert sum(v for r in matrix.values() for k, v in r.items() if k != "y_true") == 200


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([("HIGH", 40 + i % 20) for i in range(300)] + [("LOW", 5)], "criticality string, score int")
    rows = profile.kde(df, "score", "criticality", points=201).collect()
    assert {r["criticality"] for r in rows} == {"HIGH"}
    assert sum(r["density"] for r in rows) * 0.5 == pytest.approx(1.0, abs=1e-3)


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = od.top_k(df, 5, [F.desc("id")], ["g"])
    assert top.count() == 15
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
