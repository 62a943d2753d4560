"""Counts, shares, distributions and cross tables of the merged and the labelled set."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx
from noticewing.plans import order as od

def _count():
    return F.count(F.lit(1))


def merged_summary(df: DataFrame) -> DataFrame:
    """Rows (section, value, n): total, per route, per classification, empty texts; one pass."""
    tagged = df.select(
        "route", tx.strip_enum(F.col("classification")).alias("classification"), tx.is_blank(F.col("text")).alias("_blank")
    )
    sets = tagged.groupingSets([[], ["route"], ["classification"]], "route", "classification").agg(
        _count().alias("n"), F.count_if("_blank").alias("blank"), F.grouping_id("route", "classification").alias("g")
    )
    section = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "route").otherwise("classification")
    main = sets.select(
        F.explode(
            F.when(
                F.col("g") == 3,
                F.array(
                    F.struct(F.lit("total").alias("section"), F.lit("").alias("value"), F.col("n").alias("n")),
                    F.struct(F.lit("empty_text").alias("section"), F.lit("").alias("value"), F.col("blank").alias("n")),
                ),
            ).otherwise(
                F.array(F.struct(section.alias("section"), F.coalesce("route", "classification", F.lit("")).alias("value"),
                                 F.col("n").alias("n")))
            )
        ).alias("r")
    )
    return main.select("r.*")


def top_codes(df: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent selection codes, '(none)' for missing ones; ties by code."""
    code = F.coalesce(tx.null_if_blank(F.col("selection_code"), ("", "None")), F.lit("(none)"))
    counts = df.groupBy(code.alias("selection_code")).agg(_count().alias("n"))
    return od.top_k(counts, k, [F.desc("n"), F.asc("selection_code")])


def label_summary(labels: DataFrame, warn_below: int = 50, levels: Sequence[str] = domain.LEVELS) -> DataFrame:
    """Per level: count, share, bar, failed labels of the whole set, warning for a thin level."""
    total = F.count(F.lit(1)).alias("total")
    failed = F.count_if(F.coalesce(F.col("reason").startswith(domain.FAILED_PREFIX), F.lit(False))).alias("failed")
    per_level = [F.count_if(F.col("criticality") == lv).alias(lv) for lv in levels]
    row = labels.agg(total, failed, *per_level)
    pairs = F.array(*[F.struct(F.lit(lv).alias("criticality"), F.col(lv).alias("n")) for lv in levels])
    out = row.select("total", "failed", F.explode(pairs).alias("p")).select("total", "failed", "p.*")
    share = F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0)
    return out.select(
        "criticality", "n", F.round(share, 6).alias("pct"), F.repeat(F.lit("█"), F.floor(share / 2).cast("int")).alias("bar"),
        "failed", (F.col("n") < warn_below).alias("warning"),
    )


def class_distribution(df: DataFrame, levels: Sequence[str] = domain.LEVELS) -> DataFrame:
    """Count and share per level, and the LOW / HIGH ratio of the set."""
    row = df.agg(_count().alias("total"), *[F.count_if(F.col("criticality") == lv).alias(lv) for lv in levels])
    pairs = F.array(*[F.struct(F.lit(lv).alias("criticality"), F.col(lv).alias("n")) for lv in levels])
    ratio = F.when(F.col("HIGH") > 0, F.round(F.col("LOW") / F.col("HIGH"), 6))
    return row.select("total", ratio.alias("low_high_ratio"), F.explode(pairs).alias("p")).select(
        "p.criticality", "p.n", F.round(F.col("p.n") * 100.0 / F.col("total"), 6).alias("pct"), "low_high_ratio"
    )


def text_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("word_count", tx.word_count(F.col(text))).withColumn("char_count", F.length(text))


def length_counts(df: DataFrame, by: str = "criticality") -> DataFrame:
    """Rows per (class, word count): the small table every length statistic is read from."""
    return (
        df.select(by, tx.word_count(F.col("text")).alias("word_count")).dropna()
        .groupBy(by, "word_count").agg(_count().alias("n"))
    )


def length_median(df: DataFrame, by: str = "criticality") -> DataFrame:
    return length_counts(df, by).groupBy(by).agg(F.percentile("word_count", 0.5, F.col("n")).alias("median_words"))


def length_box(df: DataFrame, by: str = "criticality") -> DataFrame:
    """Five-number summary with whiskers at the last value within 1.5 quartile ranges."""
    counts = length_counts(df, by)
    quart = counts.groupBy(by).agg(F.percentile("word_count", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    fence = (F.col("q")[2] - F.col("q")[0]) * 1.5
    inside = (F.col("word_count") >= F.col("q")[0] - fence) & (F.col("word_count") <= F.col("q")[2] + fence)
    return counts.join(quart, by).groupBy(by, "q").agg(
        F.min(F.when(inside, F.col("word_count"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("word_count"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    ).select(
        by, "whisker_low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        "whisker_high", "outliers",
    )


def _bin(value, low, high, bins: int):
    """0-based equal-width bin; the top edge belongs to the last bin."""
    width = (high - low) / F.lit(float(bins))
    return F.when(high == low, 0).otherwise(F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")


def length_hist(df: DataFrame, bins: int = 40, by: str = "criticality") -> DataFrame:
    """Histogram of word counts per class over the class's own range; empty bins are left out."""
    counts = length_counts(df, by)
    ends = counts.groupBy(by).agg(F.min("word_count").alias("lo"), F.max("word_count").alias("hi"))
    placed = counts.join(ends, by).withColumn(
        "bin", _bin(F.col("word_count").cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), bins)
    )
    return placed.groupBy(by, "bin").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Histogram over the whole range of a column; empty bins are left out."""
    ends = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).alias("e"))
    placed = df.select(F.col(col).cast("double").alias("v"), ends.scalar().alias("e")).where(F.col("v").isNotNull())
    return placed.groupBy(_bin(F.col("v"), F.col("e.lo"), F.col("e.hi"), bins).alias("bin")).agg(_count().alias("n"))


def word_counts(df: DataFrame, by: str = "criticality", stopwords: Sequence[str] = domain.STOPWORDS) -> DataFrame:
    """Occurrences per (class, word)."""
    # explode_outer: a plain explode adds a filter on the array's size, which computes the array twice
    spread = df.select(by, F.explode_outer(tx.words(F.col("text"))).alias("word")).where(F.col("word").isNotNull())
    return spread.where(~tx.is_stopword(F.col("word"), stopwords)).groupBy(by, "word").agg(_count().alias("n"))


def top_words(df: DataFrame, k: int = 15, by: str = "criticality", stopwords: Sequence[str] = domain.STOPWORDS) -> DataFrame:
    return od.top_k(word_counts(df, by, stopwords), k, [F.desc("n"), F.asc("word")], [by])


def top_airports(df: DataFrame, k: int = 15, levels: Sequence[str] = ("HIGH", "LOW"), place: str = "icao_location") -> DataFrame:
    """Airports with most notices of the given levels."""
    known = tx.null_if_blank(F.col(place), ("None",))
    rows = df.where(F.col("criticality").isin(*levels)).select("criticality", known.alias(place))
    return od.top_k(od.value_counts(rows, "criticality", place), k, [F.desc("n"), F.asc(place)], ["criticality"])


def top_high_codes(df: DataFrame, k: int = 10) -> DataFrame:
    code = tx.null_if_blank(F.col("selection_code"), ("", "None")).alias("selection_code")
    rows = df.where(F.col("criticality") == "HIGH").select(code)
    return od.top_k(od.value_counts(rows, "selection_code"), k, [F.desc("n"), F.asc("selection_code")])


def crosstab(
    df: DataFrame, row: str, col: str = "criticality", levels: Sequence[str] = domain.LEVELS, normalize: str | None = None
) -> DataFrame:
    """Row value x level counts, or percentages of the row with normalize="index"."""
    kept = df.where(F.col(row).isNotNull() & F.col(col).isin(*levels))
    counts = kept.groupBy(row).agg(*[F.count_if(F.col(col) == lv).alias(lv) for lv in levels], _count().alias("_all"))
    if normalize is None:
        return counts.drop("_all")
    if normalize != "index":
        raise ValueError(f"unknown normalize: {normalize}")
    return counts.select(row, *[F.round(F.col(lv) * 100.0 / F.col("_all"), 6).alias(lv) for lv in levels])


def score_means(df: DataFrame, by: str = "criticality", dp: int = 1) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.round(F.avg("score"), dp).alias("mean_score"))


def kde(df: DataFrame, value: str, by: str, points: int = 100, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Gaussian density per class on an even grid, Scott bandwidth.

    Values are counted first (a score has about a hundred), so the work is values x grid, whatever
    the number of rows. A class without spread has no density and is left out.
    """
    if points < 2:
        raise ValueError("points must be at least 2")
    v = F.col("v")
    counts = (
        df.select(by, F.col(value).cast("double").alias("v")).dropna().groupBy(by, "v").agg(_count().cast("double").alias("n"))
    )
    n, s1, s2 = F.sum("n"), F.sum(F.col("n") * v), F.sum(F.col("n") * v * v)
    spread = counts.groupBy(by).agg(n.alias("total"), F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))).alias("sd")) \
        .where((F.col("total") > 1) & (F.col("sd") > 0)) \
        .withColumn("h", F.col("sd") * F.pow("total", F.lit(-0.2)))
    step = (hi - lo) / (points - 1)
    grid = counts.join(spread, by).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(lo) + F.col("g") * F.lit(step)
    z = (x - v) / F.col("h")
    bump = F.col("n") * F.exp(z * z * -0.5) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    return grid.groupBy(by, "g").agg(F.sum(bump).alias("density"))


def eda_findings(df: DataFrame) -> DataFrame:
    """One row of headline figures; medians come from a word-count table, not from the rows."""
    level = F.col("criticality")
    slim = (
        df.select(level, tx.word_count(F.col("text")).alias("wc"), tx.qcode_flag(F.col("selection_code")).alias("q"))
        .groupBy("criticality", "wc", "q").agg(_count().alias("n"))
    )

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    def median(lv: str):
        return F.percentile(F.when(level == lv, F.col("wc")), 0.5, F.col("n")).alias(f"{lv.lower()}_median_words")

    whole = F.sum("n")
    return slim.agg(
        whole.alias("total"),
        F.round(total(level == "HIGH") * 100.0 / whole, 6).alias("high_pct"),
        F.round(total(level == "LOW") * 100.0 / whole, 6).alias("low_pct"),
        F.round(total(F.col("q") == "No Q-Code") * 100.0 / whole, 6).alias("no_qcode_pct"),
        median("HIGH"), median("LOW"), median("INFO"),
        F.round(total(level == "LOW") / total(level == "HIGH"), 6).alias("imbalance"),
    )


def flag_rate(df: DataFrame, by: str = "criticality", flag: str = "is_anomaly") -> DataFrame:
    """Flagged rows, rows and share per group."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count_if(flag).alias("flagged"), _count().alias("total"),
        F.round(F.count_if(flag) * 100.0 / _count(), 6).alias("pct"),
    )


def nlargest(df: DataFrame, col: str, n: int, pos: str) -> DataFrame:
    """n rows with the greatest value, first in position on ties."""
    return df.where(F.col(col).isNotNull()).orderBy(F.desc(col), F.asc(pos)).limit(n)


def top_breakdown(top: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """Value counts of several columns of a top-n frame: (dimension, value, n), at most k per dimension."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in by])
    long = top.select(F.explode(pairs).alias("p")).select("p.*")
    return od.top_k(od.value_counts(long, "dimension", "value"), k, [F.desc("n"), F.asc("value")], ["dimension"])


def run_summary(scored: DataFrame) -> DataFrame:
    """One row: notices scored, disagreements, anomalies."""
    return scored.agg(
        _count().alias("scored"), F.count_if(~F.col("models_agree")).alias("disagreements"),
        F.count_if("is_anomaly").alias("anomalies"),
    )


def consensus(df: DataFrame) -> DataFrame:
    """Do the classifiers agree; the forest's level is final."""
    return df.withColumn("models_agree", F.col("lr_criticality") == F.col("rf_criticality")).withColumn(
        "final_criticality", F.col("rf_criticality")
    )
