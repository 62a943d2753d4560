"""Exact stratified split and folds by seeded hash, without ordering a class in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.plans import order as od


def stratified_split(
    df: DataFrame, label: str = "criticality", key: str = "id", test_size: float = 0.2, seed: int = 42,
    levels: Sequence[str] = domain.LEVELS,
) -> DataFrame:
    """Add is_test: ceil(n * test_size) rows, shared out to classes by largest remainder.

    The rows of a class with the smallest hashes are the test rows. Bucket counts find the bucket
    the border falls in, only that bucket is ordered, and the border (one row per class) is broadcast,
    so the rows themselves are never shuffled. `key` is unique; rows of unknown classes are left out.
    """
    hashed = df.where(F.col(label).isin(*levels)).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    slim = hashed.select(F.col(label).alias("_l"), F.col(key).alias("_k"), "_h", od.hash_bucket(F.col("_h")).alias("_b"))
    sizes = slim.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("c"))

    # One row per class from here to `quota`.
    classes = sizes.groupBy("_l").agg(F.sum("c").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    wanted = F.ceil(total * F.lit(test_size) - F.lit(1e-9))
    ideal = wanted * F.col("n") / total
    shares = classes.withColumn("base", F.floor(ideal)).withColumn("rest", ideal - F.floor(ideal)).withColumn("wanted", wanted)
    left = F.col("wanted") - F.sum("base").over(W.partitionBy())
    ranked = F.row_number().over(W.partitionBy().orderBy(F.desc("rest"), "_l"))
    quota = shares.withColumn("quota", F.col("base") + F.when(ranked <= left, 1).otherwise(0)).select("_l", "quota")

    running = W.partitionBy("_l").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    border = (
        sizes.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
        .join(F.broadcast(quota), "_l")
        .where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("c") >= F.col("quota")))
        .select("_l", "_b", (F.col("quota") - F.col("before")).alias("nth"))
    )
    inside = slim.join(F.broadcast(border), ["_l", "_b"]).withColumn(
        "r", F.row_number().over(W.partitionBy("_l", "_b").orderBy("_h", "_k"))
    )
    last = inside.where(F.col("r") == F.col("nth")).select("_l", F.col("_h").alias("_lh"), F.col("_k").alias("_lk"))
    marked = hashed.join(F.broadcast(last), F.col(label) == F.col("_l"), "left")
    in_test = (F.col("_h") < F.col("_lh")) | ((F.col("_h") == F.col("_lh")) & (F.col(key) <= F.col("_lk")))
    return marked.select(*df.columns, F.coalesce(in_test, F.lit(False)).alias("is_test"))


def stratified_folds(df: DataFrame, label: str = "criticality", key: str = "id", folds: int = 5, seed: int = 42) -> DataFrame:
    """Add fold 0..folds-1; the classes are spread evenly over the folds."""
    hashed = df.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    placed = od.grouped_position(hashed, [label], [od.hash_bucket(F.col("_h"))], [F.asc("_h"), F.asc(key)], "_r")
    return placed.select(*df.columns, ((F.col("_r") - 1) % folds).cast("int").alias("fold"))
