"""Row filters of the notice workflow."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx


def conus(
    df: DataFrame, country_values: Iterable[str] = ("United States",),
    excluded_tz: Iterable[str] = domain.EXCLUDED_TIME_ZONES,
) -> DataFrame:
    """Airports of the continental United States; an unknown time zone passes."""
    outside = F.coalesce(F.col("tz_name").isin(*excluded_tz), F.lit(False))
    return df.where(F.col("country").isin(*country_values) & ~outside)


def active_only(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop cancelled notices (the word in any case); null text stays."""
    return df.where(~F.coalesce(F.upper(F.col(text)).contains("CANCELED"), F.lit(False)))


def trainable(df: DataFrame, text: str = "text", reason: str = "reason") -> DataFrame:
    """Drop rows whose labelling failed and rows without text."""
    failed = F.coalesce(F.col(reason).startswith(domain.FAILED_PREFIX), F.lit(False))
    return df.where(~failed & ~tx.is_blank(F.col(text)))
