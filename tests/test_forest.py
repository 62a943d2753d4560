"""The node-table forest: cuts against brute force, unlimited depth, samples, saving, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticewing.models import classify, forest

LEVELS = classify.LEVELS


def gini(mass):
    total = mass.sum()
    return total - (mass**2).sum() / total if total else 0.0


@pytest.mark.parametrize("seed", range(12))
def test_cut_is_the_best(seed):
    rng = np.random.default_rng(seed)
    n, min_leaf = int(rng.integers(4, 30)), int(rng.integers(1, 4))
    x = rng.integers(0, 6, (n, 3)).astype(np.float32)
    mass = np.zeros((n, 4))
    mass[np.arange(n), rng.integers(0, 4, n)] = rng.uniform(0.5, 3, n)
    best = None
    for f in range(3):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= min_leaf:
                impurity = gini(mass[left].sum(0)) + gini(mass[~left].sum(0))
                best = impurity if best is None else min(best, impurity)
    got = forest._split(x, mass, np.arange(3), min_leaf)
    if best is None:
        assert got is None
    else:
        left = x[:, got[1]] <= got[2]
        assert min(left.sum(), (~left).sum()) >= min_leaf
        assert gini(mass[left].sum(0)) + gini(mass[~left].sum(0)) == pytest.approx(best)


def test_no_depth_limit():
    n = 400
    x = np.arange(n, dtype=np.float32)[:, None]
    mass = np.zeros((n, 4))
    mass[np.arange(n), np.arange(n) % 2] = 1.0 + np.arange(n) ** 2  # the heaviest rows are cut off one after the other
    nodes = forest.grow_tree(x, mass, np.random.default_rng(1), 1)
    depth = {0: 0}
    for me, feature, _, left, right, _ in nodes:
        if feature >= 0:
            depth[left] = depth[right] = depth[me] + 1
    assert max(depth.values()) > 30 and sum(n[1] < 0 for n in nodes) == n
    table = pa.Table.from_arrays([pa.array([(0, *r)[k] for r in nodes], type=f.type) for k, f in enumerate(forest._SCHEMA)], schema=forest._SCHEMA)
    assert (forest.Nodes(table).probabilities(x).argmax(1) == np.arange(n) % 2).all()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12))
    level = rng.integers(0, 4, 900)
    data = [(f"n{i}", LEVELS[c], (centre[c] + rng.normal(size=12) * 0.4).astype(float).tolist()) for i, c in enumerate(level.tolist())]
    return spark.createDataFrame(data, "id string, criticality string, embedding array<float>")


def test_fit_score_save(spark, rows, tmp_path):
    train, test = rows.where(F.substring("id", 2, 9).cast("int") < 700), rows.where(F.substring("id", 2, 9).cast("int") >= 700)
    model = classify.fit_rf(train, trees=30)
    again = classify.fit_rf(train.repartition(7), trees=30)
    assert model.nodes.equals(again.nodes)
    model.save(spark, f"{tmp_path}/forest")
    loaded = classify.ForestModel.load(spark, f"{tmp_path}/forest")
    one, two = (m.transform(test.withColumnRenamed("criticality", "y_true")).orderBy("id").collect() for m in (model, loaded))
    assert one == two and sum(r["y_true"] == r["criticality"] for r in one) / len(one) > 0.95
    assert all(0.25 <= r["confidence"] <= 1 for r in one)
    odd = spark.createDataFrame([("x", None), ("y", [0.0] * 12)], "id string, embedding array<float>")
    got = {r["id"]: r for r in model.transform(odd).collect()}
    assert got["x"]["criticality"] is None and got["x"]["confidence"] is None and got["y"]["criticality"] in LEVELS
    assert model.transform(odd.limit(0)).count() == 0
    model.release()


def test_samples_are_bounded_and_from_all_rows(rows):
    model = classify.fit_rf(rows, trees=20, max_samples=90, min_leaf=1)
    leaves = model.nodes.filter(pa.compute.less(model.nodes["feature"], 0)).group_by("tree").aggregate([("node", "count")])["node_count"].to_pylist()
    assert len(leaves) == 20 and max(leaves) < 150
    none = rows.limit(0)
    assert classify.fit_rf(none, trees=5).transform(none.drop("criticality")).count() == 0
