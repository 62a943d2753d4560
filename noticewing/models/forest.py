"""Random forest as a table of nodes: trees grown in parallel on bootstrap samples, as deep as it takes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing import domain

LEVELS = domain.LEVELS
#: rows a tree's bootstrap sample has in the mean, at most
MAX_SAMPLES = 10_000
#: trees that one task grows, one after the other, from the rows it gets once
TREES_PER_TASK = 5
NODES = "tree int, node int, feature int, threshold double, left int, right int, p array<double>"
_SCHEMA = pa.schema([
    ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int32()), ("right", pa.int32()),
    ("p", pa.list_(pa.float64())),
])


def _split(x: np.ndarray, mass: np.ndarray, features: np.ndarray, min_leaf: int) -> tuple[float, int, float] | None:
    """(purity, feature, threshold) of the best cut on `features` that leaves `min_leaf` rows on both sides."""
    values = x[:, features]
    order = np.argsort(values, axis=0, kind="stable")
    values = np.take_along_axis(values, order, axis=0)
    left = np.cumsum(mass[order], axis=0)
    right = left[-1] - left[:-1]
    left = left[:-1]
    with np.errstate(all="ignore"):
        purity = (left**2).sum(-1) / left.sum(-1) + (right**2).sum(-1) / right.sum(-1)
    allowed = values[1:] > values[:-1]
    allowed[: min_leaf - 1] = False
    allowed[len(allowed) - min_leaf + 1 :] = False
    if not allowed.any():
        return None
    purity[~allowed] = -np.inf
    row, col = np.unravel_index(int(np.argmax(purity)), purity.shape)
    low, high = float(values[row, col]), float(values[row + 1, col])
    middle = low + (high - low) / 2
    return float(purity[row, col]), int(features[col]), middle if low <= middle < high else low


def grow_tree(x: np.ndarray, mass: np.ndarray, rng: np.random.Generator, min_leaf: int) -> list[tuple]:
    """(node, feature, threshold, left, right, p) of one tree by weighted Gini impurity; leaves have feature -1.

    `mass` has a row's weight in the column of its level. Every node looks at the square root of all
    features, and at the others too if those allow no cut; it is a leaf if pure, too small or uncuttable.
    """
    nodes: list[list] = []
    n_features = x.shape[1]
    some = max(1, int(math.sqrt(n_features)))
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        me, total = len(nodes), mass[rows].sum(axis=0)
        if parent >= 0:
            nodes[parent][3 + side] = me
        nodes.append([me, -1, 0.0, -1, -1, (total / total.sum()).tolist()])
        if len(rows) < 2 * min_leaf or np.count_nonzero(total) < 2:
            continue
        part, own, cut = x[rows], mass[rows], None
        chance = rng.permutation(n_features)
        for at in range(0, n_features, some):
            cut = _split(part, own, chance[at : at + some], min_leaf)
            if cut:
                break
        if not cut:
            continue
        nodes[me][1], nodes[me][2] = cut[1], cut[2]
        goes_left = part[:, cut[1]] <= cut[2]
        todo.append((rows[~goes_left], me, 1))
        todo.append((rows[goes_left], me, 0))
    return [tuple(n) for n in nodes]


def _drawn(uniform: Column, rate: float) -> Column:
    """How often a row is drawn: Poisson with this mean, from a number in [0, 1)."""
    term = total = math.exp(-rate)
    times, k = F.lit(0), 0
    while total < 1 - 1e-9 and k < 20:
        times = times + (uniform >= total).cast("int")
        k += 1
        term *= rate / k
        total += term
    return times


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column without nulls as float32."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def grow_forest(rows: DataFrame, n: int, embedding: str, key: str, trees: int, min_leaf: int, max_samples: int, seed: int) -> pa.Table:
    """Nodes of all trees. `rows` have y (number of the level), weight, `embedding` and `key`.

    Seeded hashes of the key say how often a tree draws a row, so partitioning does not matter. A row
    goes once to each task that grows a tree which draws it.
    """
    rate = min(1.0, max_samples / max(n, 1))
    n_groups = -(-trees // TREES_PER_TASK)
    uniform = lambda t: F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), t), 11).cast("double") / float(1 << 53)
    times = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _drawn(uniform(t), rate))
    slim = rows.select(
        F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col("y").cast("int").alias("y"), "weight", F.col(embedding).cast("array<float>").alias("x"), times.alias("t"))
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(n_groups - 1)), lambda g: F.struct(g.alias("g"), F.slice("t", g * TREES_PER_TASK + 1, TREES_PER_TASK).alias("t")))
    wanted = F.filter(groups, lambda s: F.exists(s.t, lambda k: k > 0))
    dealt = slim.select("h", "y", "weight", "x", F.explode(wanted).alias("s")).select("h", "y", "weight", "x", "s.g", "s.t")

    def grow(part: pa.Table) -> pa.Table:
        x, y, weight = matrix(part.column("x").combine_chunks()), part.column("y").to_numpy(), part.column("weight").to_numpy()
        h = part.column("h").to_numpy()
        drawn = part.column("t").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        order = np.lexsort((x[:, 0], y, h))
        group, out = part.column("g")[0].as_py(), []
        for i in range(drawn.shape[1]):
            rows_of = order[drawn[order, i] > 0]
            if not len(rows_of):
                continue
            mass = np.zeros((len(rows_of), len(LEVELS)))
            mass[np.arange(len(rows_of)), y[rows_of]] = weight[rows_of] * drawn[rows_of, i]
            tree = group * TREES_PER_TASK + i
            out += [(tree, *node) for node in grow_tree(x[rows_of], mass, np.random.default_rng([seed, tree]), min_leaf)]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], type=f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return dealt.groupBy("g").applyInArrow(grow, NODES).toArrow()


class Nodes:
    """A forest's nodes as arrays; children by their place in them."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree = table.column("tree").to_numpy()
        self.roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if len(tree) else np.zeros(0, np.int64)
        start = np.repeat(self.roots, np.diff(np.append(self.roots, len(tree))))
        self.feature, self.threshold = table.column("feature").to_numpy().astype(np.int32), table.column("threshold").to_numpy()
        self.left, self.right = ((table.column(c).to_numpy() + start).astype(np.int32) for c in ("left", "right"))
        p = table.column("p").combine_chunks().flatten().to_numpy()
        self.p = p.reshape(len(tree), -1) if len(tree) else p.reshape(0, len(LEVELS))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the level shares of each row's leaf."""
        total = np.zeros((len(x), self.p.shape[1]))
        for root in self.roots:
            at, open_ = np.full(len(x), root, dtype=np.int32), np.arange(len(x))
            while len(open_):
                here = at[open_]
                inner = self.feature[here] >= 0
                open_, here = open_[inner], here[inner]
                left = x[open_, self.feature[here]] <= self.threshold[here]
                at[open_] = np.where(left, self.left[here], self.right[here])
            total += self.p[at]
        return total / max(len(self.roots), 1)


@dataclass
class ForestModel:
    """Fitted nodes: trees x 2 x MAX_SAMPLES / min_leaf rows at most, whatever the number of training rows."""

    nodes: pa.Table
    _shared: Broadcast | None = field(default=None, repr=False, compare=False)

    def transform(self, df: DataFrame, embedding: str = "embedding") -> DataFrame:
        """Add criticality and confidence (the largest mean share; ties: the higher level); null for a null embedding. No shuffle."""
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast(Nodes(self.nodes))
        shared = self._shared

        def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in parts:
                there = column.is_valid().to_numpy(zero_copy_only=False)
                p = shared.value.probabilities(matrix(column.filter(pa.array(there))).astype(np.float64))
                level, best = np.zeros(len(column), np.int32), np.zeros(len(column))
                level[there], best[there] = p.argmax(axis=1) if len(p) else 0, p.max(axis=1) if len(p) else 0.0
                yield pa.StructArray.from_arrays([pa.array(level, mask=~there), pa.array(best, mask=~there)], names=["level", "confidence"])

        scored = df.withColumn("_scored", F.arrow_udf(score, "struct<level:int,confidence:double>")(F.col(embedding)))
        level = F.get(F.array(*[F.lit(lv) for lv in LEVELS]), F.col("_scored.level"))
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], level.alias("criticality"), F.col("_scored.confidence").alias("confidence"))

    def release(self) -> None:
        """Let executors drop the nodes that scoring sent them."""
        if self._shared is not None:
            self._shared.unpersist()
            self._shared = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        return cls.given(spark.read.parquet(path))

    @classmethod
    def given(cls, nodes: DataFrame) -> ForestModel:
        """A model from its node rows (NODES), wherever they come from."""
        names = [f.name for f in _SCHEMA]
        return cls(nodes.select(names).toArrow().cast(_SCHEMA))
