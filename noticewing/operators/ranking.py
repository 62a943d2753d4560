"""Rule scores on notices and the ranked list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing.functions import rules
from noticewing.functions import text as tx
from noticewing.plans import order as od


def _chars(df: DataFrame, name: str):
    """The column as an array of characters, whether it comes as text or as an array."""
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else tx.char_set(F.col(name))


def score_purpose(df: DataFrame, weights: rules.Weights = rules.DEFAULT) -> DataFrame:
    return df.withColumn("purpose_score", rules.purpose(_chars(df, "purpose"), weights))


def score_type(df: DataFrame, weights: rules.Weights = rules.DEFAULT) -> DataFrame:
    return df.withColumn("type_score", rules.notice_type(F.col("type"), weights))


def score_classification(df: DataFrame, weights: rules.Weights = rules.DEFAULT) -> DataFrame:
    return df.withColumn("classification_score", rules.classification(F.col("classification"), weights))


def score_scope(df: DataFrame, weights: rules.Weights = rules.DEFAULT) -> DataFrame:
    return df.withColumn(
        "scope_score", rules.series_and_scope(F.col("series"), _chars(df, "scope"), weights)
    )


PARTS = {
    "purpose_score": score_purpose,
    "type_score": score_type,
    "classification_score": score_classification,
    "scope_score": score_scope,
}


def rule_score(
    df: DataFrame, weights: rules.Weights = rules.DEFAULT, extra: Sequence[str] = (), out: str = "rule_score"
) -> DataFrame:
    """Total rule score; `extra` names further numeric columns to add in."""
    scored = df
    for add in PARTS.values():
        scored = add(scored, weights)
    total = sum((F.col(c) for c in extra), start=F.lit(0))
    for part in PARTS:
        total = total + F.col(part)
    return scored.withColumn(out, total).drop(*PARTS)


def rank_notices(
    df: DataFrame, partition: str | None = None, pos: str | Sequence[str] = "input_pos", score: str = "rule_score",
    weights: rules.Weights = rules.DEFAULT,
) -> DataFrame:
    """Notices by descending score, ties in input order: `pos` or several columns, nulls last.

    Without `partition` the frame is sorted as a whole (a range-partitioned sort). With it a rank per
    partition value (null is one) is added; the scores and position buckets split even a route that
    holds most rows.
    """
    pos = [pos] if isinstance(pos, str) else list(pos)
    scored = df if score in df.columns else rule_score(df, weights, out=score)
    if partition is None:
        return scored.orderBy(F.desc_nulls_last(score), *[F.asc_nulls_last(p) for p in pos])

    def last(c):
        return F.coalesce(c.cast("double"), F.lit(float("inf")))

    return od.grouped_position(
        scored, [partition],
        buckets=[last(-F.col(score)), *[last(F.col(p)) for p in pos[:-1]], last(od.position_bucket(F.col(pos[-1])))],
        order=[F.asc_nulls_last(p) for p in pos], out="rank",
    )
