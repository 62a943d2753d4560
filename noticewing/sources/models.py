"""Saving and loading the models a scoring run needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from noticewing.models import classify, iforest

KINDS = {
    "linear": classify.LinearModel,
    "forest": classify.ForestModel,
    "isolation": iforest.IsolationForestModel,
}


@dataclass
class Models:
    linear: classify.LinearModel
    forest: classify.ForestModel
    isolation: iforest.IsolationForestModel


def save_models(models: Models, spark: SparkSession, path: str) -> None:
    """Write every model under its name; the folder must be new."""
    for name in KINDS:
        getattr(models, name).save(spark, f"{path}/{name}")


def load_models(spark: SparkSession, path: str) -> Models:
    """Load every model, or name all that are missing."""
    missing = [name for name in KINDS if not _exists(spark, f"{path}/{name}")]
    if missing:
        raise FileNotFoundError(f"Missing trained models: {missing}; train them first")
    return Models(**{name: kind.load(spark, f"{path}/{name}") for name, kind in KINDS.items()})


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
