"""Classifier metrics over the four fixed levels, from counts of (true, predicted) pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain

METRICS = ("accuracy", "macro_f1", "weighted_f1", "high_f1")


def pair_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """At most levels x levels rows; everything below reads only this."""
    return df.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", levels: Sequence[str] = domain.LEVELS) -> DataFrame:
    """Square count matrix in level order, absent pairs 0."""
    pairs = pair_counts(df, y_true, y_pred)
    cell = [
        F.struct(
            F.lit(t).alias("y_true"),
            *[F.coalesce(F.sum(F.when((F.col("t") == t) & (F.col("p") == p), F.col("n"))), F.lit(0)).alias(p) for p in levels],
        )
        for t in levels
    ]
    return pairs.agg(F.array(*cell).alias("m")).select(F.explode("m").alias("r")).select("r.*")


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def _counts(pairs: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per level: true positives, predicted, support, plus the correct and overall totals."""

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")

    t, p = F.col("t"), F.col("p")
    per_level = [
        F.struct(
            F.lit(lv).alias("criticality"), total((t == lv) & (p == lv)).alias("tp"),
            total(p == lv).alias("predicted"), total(t == lv).alias("support"),
        )
        for lv in levels
    ]
    return pairs.agg(
        F.array(*per_level).alias("m"), total(t == p).alias("correct"), F.sum("n").cast("double").alias("total")
    ).select("correct", "total", F.explode("m").alias("r")).select("r.*", "correct", "total")


def _with_scores(pairs: DataFrame, levels: Sequence[str]) -> DataFrame:
    scored = _counts(pairs, levels)
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(F.col("tp") * 2.0, F.col("predicted") + F.col("support"))
    return scored.withColumns({"precision": precision, "recall": recall, "f1": f1})


def class_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", levels: Sequence[str] = domain.LEVELS) -> DataFrame:
    """Precision, recall, F1 and support per level; 0 where undefined."""
    scored = _with_scores(pair_counts(df, y_true, y_pred), levels)
    return scored.select(
        "criticality", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        F.col("support").cast("long").alias("support"),
    )


def model_metrics(
    df: DataFrame, name: str, y_true: str = "y_true", y_pred: str = "y_pred", levels: Sequence[str] = domain.LEVELS, dp: int = 1
) -> DataFrame:
    """One row: accuracy, macro F1, weighted F1 and HIGH F1 in percent."""
    scored = _with_scores(pair_counts(df, y_true, y_pred), levels)
    weighted = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    return scored.agg(
        (F.max("correct") / F.max("total")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        weighted.alias("weighted_f1"), F.max(F.when(F.col("criticality") == "HIGH", F.col("f1"))).alias("high_f1"),
    ).select(F.lit(name).alias("model"), *[F.round(F.col(m) * 100, dp).alias(m) for m in METRICS])


def compare_models(metrics: Sequence[DataFrame] | DataFrame) -> DataFrame:
    """Winner and spread per metric; the first model wins a tie by name."""
    rows = metrics if isinstance(metrics, DataFrame) else reduce(DataFrame.unionByName, metrics)
    long = rows.unpivot(["model"], list(METRICS), "metric", "value")
    best = F.min_by("model", F.struct(-F.col("value"), F.col("model")))
    return long.groupBy("metric").agg(best.alias("winner"), F.round(F.max("value") - F.min("value"), 1).alias("spread"))
