"""Removing duplicate notices, and first-good-attempt selection of labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.plans import order as od


def keep_first(df: DataFrame, key: str, order: Sequence[str], scope: str = "all") -> DataFrame:
    """Keep the first row per key along `order`.

    scope="all" keeps one row; scope="across_waypoints" keeps every row of the first value of
    order[0], that is repeats inside one response survive.
    """
    if scope == "all":
        return od.keep_first(df, key, order)
    if scope != "across_waypoints":
        raise ValueError(f"unknown scope: {scope}")
    first = df.groupBy(key).agg(F.min(order[0]).alias(order[0]))
    return df.join(first, [key, order[0]], "left_semi")


def dedupe_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: rows read, rows kept, duplicates removed."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("kept"),
        (F.coalesce(F.sum("c"), F.lit(0)) - F.count(F.lit(1))).alias("removed"),
    )


def union_routes(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate route datasets, remembering their order in route_no."""
    tagged = [df.withColumn("route_no", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_success(attempts: DataFrame, max_attempts: int = domain.MAX_ATTEMPTS) -> DataFrame:
    """Label of the first good attempt per notice, else a failure row that names the last error.

    Input: notice_id, attempt, status, reply, and optionally error. Retry statuses leave no error
    behind, so a notice with nothing else fails with 'None'.
    """
    given = F.col("error") if "error" in attempts.columns else F.lit(None).cast("string")
    tried = (
        attempts.where(F.col("attempt") <= max_attempts)
        .withColumn("_label", tx.parse_reply(F.col("reply")))
        .withColumn("_ok", (F.col("status") == 200) & F.col("_label.ok"))
        .withColumn(
            "_error",
            F.when(F.col("_ok") | F.col("status").isin(*domain.RETRY_STATUSES), None)
            .otherwise(F.coalesce(given, F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
                                  .otherwise("invalid reply"))),
        )
    )
    label = F.struct("_label.criticality", "_label.score", "_label.reason", "attempt")
    per_id = tried.groupBy("notice_id").agg(
        F.min_by(label, F.when(F.col("_ok"), F.col("attempt"))).alias("_won"),
        F.max_by("_error", F.when(F.col("_error").isNotNull(), F.col("attempt"))).alias("_last"),
    )
    failed = F.concat(F.lit(f"{domain.FAILED_PREFIX}: "), F.left(F.coalesce("_last", F.lit("None")), F.lit(100)))
    return per_id.select(
        "notice_id",
        F.coalesce("_won.criticality", F.lit("INFO")).alias("criticality"),
        F.coalesce("_won.score", F.lit(0)).alias("score"),
        F.when(F.col("_won").isNotNull(), F.col("_won.reason")).otherwise(failed).alias("reason"),
        F.col("_won.attempt").alias("attempt"),
    )
