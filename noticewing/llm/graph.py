"""Connected components of a link table, by star operations in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`id`, `component`): every id that has a link, with the smallest id it is connected to.

    Large-star and small-star steps alternate until the links no longer change (Kiveris et al.,
    Connected Components in MapReduce and Beyond, 2014): long chains take a logarithmic number of
    rounds, and a node with many links only ever needs the minimum over them, which map tasks
    reduce first. Each round is written to the shared folder. Loops and repeated links do no harm.
    """
    one, two = F.greatest(a, b), F.least(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(one.alias("u"), two.alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
