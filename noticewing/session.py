"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits hot join partitions and turns joins with a side that proves small at
#: run time into broadcast joins; the library leaves both decisions to it instead of hinting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "noticewing", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the library's settings; `extra` uses __ for dots (spark__sql__shuffle__partitions)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
