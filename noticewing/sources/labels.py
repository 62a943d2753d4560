"""The labelled set and the store of labels already made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.plans import order as od

LABELED = ", ".join(f"{c} {'int' if c == 'score' else 'string'}" for c in domain.LABELED_COLUMNS)
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def write_labeled(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Parquet, the store for large sets, or CSV with doubled quotes for exchange."""
    out = df.select(*domain.LABELED_COLUMNS)
    if format == "csv":
        out.write.options(**_CSV, emptyValue="").csv(path)
    else:
        out.write.format(format).save(path)


def read_labeled(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The labelled set; every spelling of a missing value is null."""
    if format == "csv":
        return pandas_nulls(spark.read.schema(LABELED).options(**_CSV).csv(path))
    return pandas_nulls(spark.read.format(format).load(path))


def pandas_nulls(df: DataFrame) -> DataFrame:
    """Null for the strings a CSV reader of the labelled set takes as missing."""
    strings = {c: tx.null_if_blank(F.col(c), domain.CSV_NULLS) for c, t in df.dtypes if t == "string"}
    return df.withColumns(strings)


def upsert_labels(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with new labels added or replacing old ones; failed labels are not kept, so they are retried."""
    good = new.where(~F.coalesce(F.col("reason").startswith(domain.FAILED_PREFIX), F.lit(False)))
    both = good.withColumn("_age", F.lit(0)).unionByName(store.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return od.keep_first(both, "notice_id", ["_age"]).drop("_age")


def save_store(labels: DataFrame, root: str) -> None:
    """Write the whole store as its next version; readers keep the old one until this is complete."""
    spark = labels.sparkSession
    latest = _latest(spark, root)
    # What a failed writer left under the number is no version yet and is written over.
    labels.write.mode("overwrite").parquet(f"{root}/version={0 if latest is None else latest + 1}")


def load_store(spark: SparkSession, root: str) -> DataFrame:
    """Newest version of the label store, empty when there is none."""
    latest = _latest(spark, root)
    if latest is None:
        return spark.createDataFrame([], "notice_id string, criticality string, score int, reason string")
    return spark.read.parquet(f"{root}/version={latest}")


def _latest(spark: SparkSession, root: str) -> int | None:
    """Newest version that was written to its end; half-written ones are passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = []
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and files.exists(done):
            found.append(int(name.removeprefix("version=")))
    return max(found, default=None)
