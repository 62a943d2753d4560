import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticewing.plans import selection


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


def _check(spark, groups, probs):
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]]
    got = {(r["g"], r["prob"]): r["quantile"] for r in selection.quantiles(_frame(spark, rows), "v", probs, "g").collect()}
    assert len(got) == len(groups) * len(probs)
    for (g, p), q in got.items():
        assert q == pytest.approx(float(np.quantile(groups[g], p)), rel=1e-12, abs=1e-300), (g, p)


@pytest.mark.parametrize("most", [30, 1 << 18])
def test_quantiles_of_far_narrow_and_repeated_values(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST", most)
    rng = random.Random(5)
    groups = {
        "far": [*(rng.gauss(0, 1e-9) for _ in range(1500)), 1e300, -1e300],
        "narrow": [1e6 + 1e-7 * i for i in range(900)],
        "hot": [0.25 if i % 3 == 0 else rng.random() for i in range(1200)],
        "one": [4.0],
        None: [float(i % 7) for i in range(400)],
    }
    _check(spark, groups, [0.0, 0.05, 0.5, 0.95, 1.0])


def test_brackets_are_proved_and_bounded(spark, monkeypatch):
    """Sketches with errors beyond the margin: brackets that miss their rank are replaced, all end small."""
    monkeypatch.setattr(selection, "MOST", 20)
    monkeypatch.setattr(selection, "SKETCH", 8)
    monkeypatch.setattr(selection, "SPARE", 0)
    rng = random.Random(6)
    values = sorted(rng.expovariate(1) ** 9 for _ in range(4000))
    base = _frame(spark, [("a", v) for v in values]).select(F.col("g").alias("_by"), "v")
    rows = selection.brackets(base, [(F.floor(F.col("n") * F.lit(i / 6)) + 1, i) for i in range(6)]).collect()
    assert sorted(r["i"] for r in rows) == list(range(6))
    for r in rows:
        inside = [v for v in values if r["lo"] < v < r["hi"]]
        assert len(inside) <= 20 and r["lo"] <= values[r["r"] - 1] <= r["hi"]
        assert r["lt_lo"] == sum(v < r["lo"] for v in values)


def test_nan_is_largest_and_empty_gives_nothing(spark):
    rows = [("a", v) for v in (1.0, 2.0, math.inf, math.nan, math.nan)] + [("b", math.nan), ("c", -math.inf)]
    got = {(r["g"], r["prob"]): r["quantile"] for r in selection.quantiles(_frame(spark, rows), "v", [0.25, 0.5, 1.0], "g").collect()}
    assert got[("a", 0.25)] == 2.0 and got[("a", 0.5)] == math.inf and math.isnan(got[("a", 1.0)])
    assert math.isnan(got[("b", 0.5)]) and got[("c", 0.5)] == -math.inf
    assert selection.quantiles(_frame(spark, rows).where("false"), "v", [0.5]).count() == 0
    assert selection.quantiles(_frame(spark, [("a", None)]), "v", [0.5], "g").count() == 0
