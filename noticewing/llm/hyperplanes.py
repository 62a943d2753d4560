"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine verification, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.llm.common import written
from noticewing.llm.graph import components
from noticewing.llm.vectors import matrix, same_width, usable

#: a pair at the threshold shares one table at least with this probability
RECALL = 0.999999
#: sign bits of a table
BITS = 16
#: vectors of a block: pairs of blocks are compared, not pairs of rows
BLOCK = 1024


def tables_for(threshold: float, bits: int = BITS, recall: float = RECALL) -> int:
    """Tables needed: two vectors at this cosine agree in a bit with probability 1 - angle / pi."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _codes(width: int, n_tables: int, bits: int, seed: int):
    """Sign codes of a vector in every table, as an array of ints."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def code(column: pa.Array) -> pa.Array:
        planes = np.random.default_rng(seed).standard_normal((width, n_tables * bits))
        side = (matrix(column) @ planes > 0).reshape(len(column), n_tables, bits)
        codes = (side * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * n_tables), pa.array(codes.ravel()))

    return code


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n, by repeated minima over links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n_links", pa.int64())])


def _compare(threshold: float):
    """For one pair of blocks of a bucket: links of every vector to different ones, and a forest that joins them."""

    def run(part: pa.Table) -> pa.Table:
        table, first, second = (part.column(c)[0].as_py() for c in ("_t", "_i", "_j"))
        block = part.column("_block").to_numpy()
        x, codes = matrix(part.column("_v")), matrix(part.column("_codes")).astype(np.int64)
        node, copies = part.column("_node").to_numpy(), part.column("_copies").to_numpy()
        by = np.argsort(node, kind="stable")
        x, codes, node, copies, block = x[by], codes[by], node[by], copies[by], block[by]
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        count = np.zeros(len(node), dtype=np.int64)
        ends: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)]
        for i in range(0, len(left), 256):
            some = left[i : i + 256]
            near = unit[some] @ unit[right].T >= threshold - 1e-9
            if first == second:
                near &= some[:, None] < right[None, :]
            a, b = np.nonzero(near)
            a, b = some[a], right[b]
            if not len(a):
                continue
            met = (codes[a, :table] == codes[b, :table]).any(axis=1)  # an earlier table has counted it
            a, b = a[~met], b[~met]
            cosine = (x[a] * x[b]).sum(axis=1) / (np.sqrt((x[a] * x[a]).sum(axis=1)) * np.sqrt((x[b] * x[b]).sum(axis=1)))
            a, b = a[cosine >= threshold], b[cosine >= threshold]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            ends.append(np.stack((a, b), axis=1))
        pairs = np.concatenate(ends)
        root = _roots(len(node), pairs[:, 0], pairs[:, 1])
        some = np.flatnonzero((count > 0) | (root != np.arange(len(node))))
        return pa.Table.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(count[some])], schema=_LINKS)

    return run


def near_vectors(df: DataFrame, threshold: float = 0.98, *, key: str = "vec_id", vec: str = "embedding", label: str = "label", bits: int = BITS, seed: int = 17) -> DataFrame:
    """One row per row of `df`: `key`, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they share the sign code of a table and
    their cosine, in double precision on the original vectors, is `threshold` or more. n_links counts
    the other rows linked to a row, component_id is the smallest key connected with it and kept tells
    whether it is that row's. Null, empty and zero vectors, vectors with null or non-finite
    components and null labels link with nothing: no links, themselves the component. Vectors of
    different widths do not link. An empty table gives no rows; keys are taken to be distinct.

    Equal vectors of a label are one node with a count, so groups of copies of any size cost one
    comparison. Buckets are cut into blocks of about BLOCK vectors; pairs of blocks are the units of
    work, and only counts and spanning links leave them, never pairs. A pair that several tables
    bring together counts in the first.
    """
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vec}`").alias("_v"), F.col(f"`{label}`").alias("_label"))
    rows = same_width(rows, "_v")
    fine = rows.where(usable("_v") & F.col("_label").isNotNull()).withColumn("_v", F.transform("_v", lambda x: x.cast("double") + F.lit(0.0)))
    grouped = fine.groupBy("_label", "_width", "_v").agg(F.min("_key").alias("_node"), F.count(F.lit(1)).alias("_copies"))
    nodes = written(grouped)
    n_tables = tables_for(threshold, bits)
    widths = [r[0] for r in nodes.select("_width").distinct().collect()]  # a handful of model widths
    links = None
    for width in widths:
        coded = nodes.where(F.col("_width") == width).withColumn("_codes", _codes(width, n_tables, bits, seed)("_v"))
        slots = coded.select("_label", "_node", F.posexplode("_codes").alias("_t", "_code"))
        sizes = slots.groupBy("_label", "_t", "_code").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        shared = slots.join(sizes, ["_label", "_t", "_code"]).select(
            "*", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
        shared = shared.withColumn("_block", F.pmod(F.xxhash64("_node", "_t"), F.col("_blocks")).cast("int"))
        # A block meets every other one of its bucket once, and itself.
        met = shared.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        met = met.select("*", F.least("_block", "_with").alias("_i"), F.greatest("_block", "_with").alias("_j"))
        full = met.join(coded.select("_node", "_v", "_codes", "_copies", F.col("_label").alias("_l2")), "_node")
        compared = full.groupBy("_label", "_t", "_code", "_i", "_j").applyInArrow(
            _compare(threshold), "node long, other long, n_links long")
        links = compared if links is None else links.unionByName(compared)
    every = rows.select("_key", "_v", "_label", "_width")
    if links is None:
        return every.select(F.col("_key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"), F.lit(True).alias("kept"))
    links = written(links)
    counts = links.groupBy("node").agg(F.sum("n_links").alias("_links"))
    parts = components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    of_node = (
        nodes.join(counts, nodes["_node"] == counts["node"], "left").drop("node")
        .join(parts, nodes["_node"] == parts["node"], "left")
        .select("_label", "_width", "_v", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"), F.coalesce("component", "_node").alias("_component"))
    )
    found = fine.join(of_node, ["_label", "_width", "_v"]).select("_key", "_links", "_component")
    rest = rows.where(~F.coalesce(usable("_v") & F.col("_label").isNotNull(), F.lit(False))).select("_key", F.lit(0).cast("long").alias("_links"), F.col("_key").alias("_component"))
    return found.unionByName(rest).select(
        F.col("_key").alias(key), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("_key").eqNullSafe(F.col("_component")).alias("kept"))
