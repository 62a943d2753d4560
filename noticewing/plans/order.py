"""Ordered positions, order statistics and top-k that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticewing.plans.selection import quantiles

#: width of a bucket of integer positions: at most this many rows share one (group, bucket)
POSITION_WIDTH = 1 << 20


def position_bucket(pos: Column) -> Column:
    """Bucket of a unique integer position; bounded in rows because positions do not repeat."""
    return F.floor(pos / F.lit(POSITION_WIDTH))


def hash_bucket(hashed: Column) -> Column:
    """Order-keeping bucket of a 64-bit hash."""
    return F.shiftright(hashed, 48)


def grouped_position(
    df: DataFrame, by: Sequence[str], buckets: Sequence[Column], order: Sequence[Column], out: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row within its `by` group.

    `buckets` must not decrease along `order`. Only one bucket is sorted per task; the number of
    rows in the buckets before it comes from a count table. Null `by` values are a group of their own;
    bucket columns must not be null.
    """
    names = [f"_bucket{i}" for i in range(len(buckets))]
    cut = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    keys = [*by, *names]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    running = W.partitionBy(*by).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_start"))
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    there = starts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_start")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return local.join(there, same).select(*df.columns, (F.col("_start") + F.col("_local")).alias(out))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row per probability with the linearly interpolated quantile of a numeric column; nulls are left out."""
    return quantiles(df, value, probs)


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of every key by the order columns.

    An aggregate, not a window: map tasks reduce their own copies first, so a key that holds most of
    the rows still sends one row per task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First k rows per group. Spark cuts each partition to k rows before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(k)
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def value_counts(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Rows per value, null values left out."""
    return df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def exact_quantiles_by(df: DataFrame, value: str, probs: Sequence[float], by: str) -> DataFrame:
    """(`by`, prob, quantile) for every value of `by`, null included."""
    return quantiles(df, value, probs, by)
