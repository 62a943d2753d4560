"""Sharding by sampled splitters: near-equal contiguous ranges of a key, whatever the sizes and repeats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticewing.llm.common import uniform, without, written

#: first ranges per shard, and draws per range
RANGES_PER_SHARD, DRAWS_PER_RANGE = 4, 32
#: a range with more rows is divided again
ROWS_PER_RANGE = 1_000_000
#: null keys sort before all others
NULL_KEY = -(1 << 63)


def _splitters(drawn: pd.DataFrame, n: int) -> list[tuple[int, int]]:
    """Keys at the n-quantiles of the drawn weight."""
    drawn = drawn.sort_values(["_key", "_salt"])
    upto = drawn["_weight"].cumsum().to_numpy()
    if not len(upto):
        return []
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    picked = drawn.iloc[np.unique(np.minimum(at, len(upto) - 1))]
    return list(zip(picked["_key"].astype(int), picked["_salt"].astype(int)))


def _range_of(splitters: list[tuple[int, int]]):
    """Column function: number of splitters at or below (key, salt)."""
    cuts = sorted(set(splitters))
    keys = np.array([k for k, _ in cuts], dtype=np.int64)
    salts = np.array([s for _, s in cuts], dtype=np.int64)

    @F.pandas_udf("long")
    def find(key: pd.Series, salt: pd.Series) -> pd.Series:
        k, s = key.to_numpy(np.int64), salt.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for first in np.unique(low[low < high]):  # keys that are splitters themselves: the salt decides
            rows = (low == first) & (high > first)
            last = high[rows][0]
            high[rows] = first + np.searchsorted(salts[first:last], s[rows], "right")
        return pd.Series(high)

    return find


def _draw(rows: DataFrame, rate: Column, round_no: int) -> pd.DataFrame:
    """Each row with probability min(1, rate), weighing max(1, rate)."""
    drawn = rows.withColumn("_rate", rate).where(uniform("_key", "_salt", F.lit(round_no)) < F.col("_rate"))
    return drawn.select("_key", "_salt", F.greatest(F.col("_rate"), F.lit(1.0)).alias("_weight")).toPandas()


def range_shards(
    df: DataFrame, key: str, size: str, n_shards: int, *, rows_per_range: int = ROWS_PER_RANGE, draws_per_range: int = DRAWS_PER_RANGE
) -> DataFrame:
    """`df` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Shards are consecutive ranges of the integer key `key`, equal in `size` up to one row. Method:
    draw a sample of keys weighted by size, cut at its quantiles, range-partition all rows, divide
    ranges that hold too many rows by a new sample until none does, then place every row by the sizes
    before it. A salt fixed when the rows are written breaks ties, so repeated keys and repeated rows
    divide like any others. Only draws (a fixed number per range) and range counts (one row per
    million rows or fewer) reach the driver.

    Null keys come first; null or negative sizes count 0 (if all do, shards are by rows). An empty
    table gives no rows. Columns called shard or slot are replaced. All columns are carried along:
    give slim columns for wide rows and use `write_shards` for the rows themselves.
    """
    spark = df.sparkSession
    carried = without(df, "shard", "slot")
    rows = written(
        carried.withColumns({
            "_key": F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)),
            "_salt": F.monotonically_increasing_id(),
            "_size": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)),
        })
    )
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if not total:
        rows = rows.withColumn("_size", F.lit(1).cast("long"))
        total = n_rows
    draws = RANGES_PER_SHARD * n_shards * draws_per_range
    splitters = _splitters(_draw(rows, F.col("_size") * F.lit(draws / max(total, 1)), 0), RANGES_PER_SHARD * n_shards)
    round_no = 0
    while True:
        ranged = rows.withColumn("_range", _range_of(splitters)("_key", "_salt"))
        counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")).toPandas().sort_values("_range")
        overfull = counts[counts["n"] > rows_per_range]
        if overfull.empty:
            break
        round_no += 1
        need = {int(r): int(-(-n // rows_per_range)) * 2 for r, n in zip(overfull["_range"], overfull["n"])}
        wanted = spark.createDataFrame(
            [(r, need[r] * draws_per_range / int(n)) for r, n in zip(overfull["_range"], overfull["n"])], "_range long, _take double"
        )
        inside = ranged.join(F.broadcast(wanted), "_range")
        drawn = inside.where(uniform("_key", "_salt", F.lit(round_no)) < F.col("_take")).select("_range", "_key", "_salt").toPandas()
        for r, part in drawn.groupby("_range"):
            splitters += _splitters(part.assign(_weight=1.0), need[int(r)])
    starts = counts.assign(_rows_before=counts["n"].cumsum() - counts["n"], _size_before=counts["bytes"].cumsum() - counts["bytes"])
    table = [tuple(map(int, x)) for x in starts[["_range", "_rows_before", "_size_before"]].itertuples(index=False)]
    before = spark.createDataFrame(table, "_range long, _rows_before long, _size_before long")
    order = W.partitionBy("_range").orderBy("_key", "_salt")
    placed = ranged.withColumns({
        "_nth": F.row_number().over(order),
        "_upto": F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
    }).join(F.broadcast(before), "_range")
    middle = (F.col("_size_before") + F.col("_upto")) * 2 - F.col("_size")
    placed = written(placed.select(
        *[F.col(f"`{c}`") for c in carried.columns],
        F.least(F.floor(middle * F.lit(n_shards) / F.lit(2 * max(total, 1))), F.lit(n_shards - 1)).cast("int").alias("shard"),
        (F.col("_rows_before") + F.col("_nth")).alias("_place"),
    ))
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *[F.col(f"`{c}`") for c in carried.columns], "shard", (F.col("_place") - F.col("_first")).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Rows with `shard` and `slot` as one folder per shard, in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
