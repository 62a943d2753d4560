"""Isolation forest (Liu, Ting, Zhou 2008) as a table of nodes: one small sample per tree, trees built
in parallel, rows scored in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing.plans import order as od
from noticewing.plans import storage

PERCENTILE = 0.95
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
_SCALE = 1 << 30


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    with np.errstate(all="ignore"):
        many = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def grow_tree(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """(node, feature, threshold, left, right, size, depth) of one tree; leaves have feature -1."""
    nodes: list[list] = []
    todo = [(points, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        nodes.append([me, -1, 0.0, -1, -1, len(part), depth])
        if depth >= limit or len(part) <= 1:
            continue
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        nodes[me][1], nodes[me][2] = feature, cut
        todo.append((part[~goes_left], depth + 1, me, 1))
        todo.append((part[goes_left], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def path_lengths(x: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Mean depth at which each row is isolated."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype="int64")
        for _ in range(int(t["depth"].max())):
            feature = t["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            left = x[rows, np.where(inner, feature, 0)] <= t["threshold"][at]
            at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
        total += t["depth"][at] + average_path(t["size"][at])
    return total / max(len(trees), 1)


@dataclass
class IsolationForestModel:
    """Fitted nodes (at most trees x 2 psi rows), sample size and training offset."""

    nodes: pd.DataFrame
    psi: int
    offset: float

    @classmethod
    def fit(
        cls, df: DataFrame, embedding: str = "embedding", key: str = "id", trees: int = 200, psi: int = 256,
        contamination: float = 0.05, seed: int = 42,
    ) -> IsolationForestModel:
        """Fit on all rows: trees on hashed samples, offset from every training score."""
        nodes, psi = grow_forest(df, embedding, key, trees, psi, seed)
        model = cls(nodes, psi, 0.0)
        # written once, because the quantile reads the scores twice
        scores = storage.written(model.transform(df.select(key, embedding), embedding).select("anomaly_score"))
        cut = od.exact_quantiles(scores, "anomaly_score", [1.0 - contamination]).first()
        return cls(nodes, psi, -float(cut["quantile"]))

    def transform(self, df: DataFrame, embedding: str = "embedding", out: str = "anomaly_score") -> DataFrame:
        """Add the anomaly score, higher is stranger; above 0 is an anomaly of the training set."""
        shared = df.sparkSession.sparkContext.broadcast(_arrays(self.nodes))
        scale, offset = float(average_path(self.psi)) or 1.0, self.offset

        def score(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            x = np.stack([np.asarray(v, dtype="float64") for v in vectors])
            return pd.Series(np.exp2(-path_lengths(x, shared.value) / scale) + offset)

        score.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(score, "double")(F.col(embedding)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.psi, self.offset)], "psi int, offset double").coalesce(1).write.parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        params = spark.read.parquet(f"{path}/params").first()
        return cls(spark.read.parquet(f"{path}/nodes").toPandas(), params["psi"], params["offset"])


def grow_forest(df: DataFrame, embedding: str, key: str, trees: int, psi: int, seed: int) -> tuple[pd.DataFrame, int]:
    """(node table, sample size). Seeded hashes of the key pick rows, so partitioning does not matter.

    Every tree draws from all rows: those whose hash for the tree is below a bound that leaves four
    samples on average, then the psi smallest. A tree that gets fewer is an error.
    """
    n = df.count()
    take = min(psi, n)
    limit = math.ceil(math.log2(max(take, 2)))
    bound = min(1.0, 4.0 * psi / max(n, 1))
    k, v = F.col(key).alias("k"), F.col(embedding).alias("v")

    def drawn_by(tree):
        return F.pmod(F.xxhash64(F.col(key), F.lit(seed), tree), F.lit(_SCALE)) < F.lit(int(bound * _SCALE))

    trees_of = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn_by)
    drawn = df.select(k, v, F.explode(trees_of).alias("tree")).withColumn("h", F.xxhash64("k", F.lit(seed), "tree"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        if len(pdf) < take:
            raise ValueError(f"tree {tree} drew {len(pdf)} rows of {take}")
        chosen = pdf.sort_values(["h", "k"]).head(take)
        points = np.stack([np.asarray(v, dtype="float64") for v in chosen["v"]])
        grown = grow_tree(points, limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *r) for r in grown], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    nodes = drawn.groupBy("tree").applyInPandas(build, NODES).toPandas()
    if n and nodes["tree"].nunique() < trees:
        raise ValueError(f"only {nodes['tree'].nunique()} of {trees} trees drew rows")
    return nodes.sort_values(["tree", "node"], ignore_index=True), take


def _arrays(nodes: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    columns = ["feature", "threshold", "left", "right", "size", "depth"]
    return [{c: t[c].to_numpy() for c in columns} for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")]


def flag(
    df: DataFrame, score: str = "anomaly_score", mode: str = "batch_percentile", out: str = "is_anomaly", by: str | None = None
) -> DataFrame:
    """Mark anomalies: above 0 for "fit_offset", at or above the batch's 95th percentile for "batch_percentile".

    `by` makes each of its values a batch of its own (null is one too). The percentile reads `df`
    again; write expensive scores to a table first. A null score is never an anomaly.
    """
    if mode == "fit_offset":
        return df.withColumn(out, F.col(score) > 0)
    if mode != "batch_percentile":
        raise ValueError(f"unknown mode: {mode}")
    if by is None:
        threshold = od.exact_quantiles(df, score, [PERCENTILE]).select("quantile").scalar()
        return df.withColumn(out, F.col(score) >= threshold)
    cut = od.exact_quantiles_by(df, score, [PERCENTILE], by).select(F.col(by).alias("_by"), F.col("quantile").alias("_cut"))
    names = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.join(cut, F.col(by).eqNullSafe(F.col("_by")), "left").select(*names, F.coalesce(F.col(score) >= F.col("_cut"), F.lit(False)).alias(out))
