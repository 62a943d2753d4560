"""Shared scratch folder for tables a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="noticewing-")


def scratch(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir.

    Where the setting is missing a local session gets a temporary folder; a cluster has to name one,
    because executors do not share a machine's disk.
    """
    base = spark.conf.get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As `written`, with the rows dealt into as many buckets by `column` as shuffles have partitions.

    Joins and groupings by that column read the buckets as they are and shuffle only what comes from
    elsewhere. For columns whose values have few rows each: a bucket is one task's.
    """
    spark = df.sparkSession
    name, n = f"noticewing_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.format("parquet").option("path", scratch(spark)).bucketBy(n, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry: the files stay, and `out` knows them
    return out
