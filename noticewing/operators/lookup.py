"""Airport and facility lookups, label joins and feature alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import text as tx

AIRPORT_INFO = ("name", "country", "iata", "icao", "lat", "lon", "elevation", "tz_name")
FACILITY_INFO = ("name", "country", "iata", "icao", "lat", "lon", "elevation", "state_name")


def code_index(places: DataFrame, info: Sequence[str] = AIRPORT_INFO, pos: str = "pos") -> DataFrame:
    """One row per code, local or ICAO, holding the first place in file order that carries it."""
    codes = places.select(
        pos, F.struct(*info).alias("_info"), F.explode(F.array_distinct(F.array("iata", "icao"))).alias("code")
    )
    return (
        codes.where(F.col("code").isNotNull())
        .groupBy("code").agg(F.min_by("_info", pos).alias("_info"))
        .select("code", "_info.*")
    )


def lookup_airports(
    codes: DataFrame, places: DataFrame, on_missing: str = "reject", code: str = "code",
    info: Sequence[str] = AIRPORT_INFO, pos: str = "pos",
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Attach place columns by code.

    on_missing="reject" returns (found, rejects); "raise" fails the query on the first unknown code.
    The code table is unique, so the join is an equi-join Spark broadcasts when it measures small and
    splits on hot codes when it does not.
    """
    index = code_index(places, info, pos).withColumnRenamed("code", "_code")
    joined = codes.join(index, F.col(code) == F.col("_code"), "left")
    if on_missing == "raise":
        checked = F.when(
            F.col("_code").isNull(),
            F.raise_error(F.concat(F.lit("Airport code '"), F.coalesce(F.col(code), F.lit("null")), F.lit("' not found"))),
        ).otherwise(F.col(code))
        return joined.withColumn(code, checked).drop("_code")
    if on_missing != "reject":
        raise ValueError(f"unknown on_missing: {on_missing}")
    found = joined.where(F.col("_code").isNotNull()).drop("_code")
    rejects = codes.join(index.select("_code"), F.col(code) == F.col("_code"), "left_anti")
    return found, rejects


def facilities_as_places(facilities: DataFrame) -> DataFrame:
    """Facility columns under the place names; blanks are null."""

    def clean(name: str):
        return tx.null_if_blank(F.col(name).cast("string"), ("", "NaN"))

    return facilities.select(
        "pos",
        clean("ARPT_NAME").alias("name"), clean("COUNTRY_CODE").alias("country"),
        clean("ARPT_ID").alias("iata"), clean("ICAO_ID").alias("icao"),
        tx.to_number(clean("LAT_DECIMAL")).alias("lat"), tx.to_number(clean("LONG_DECIMAL")).alias("lon"),
        tx.to_number(clean("ELEV")).cast("int").alias("elevation"), clean("STATE_NAME").alias("state_name"),
    )


def tag_route(df: DataFrame, routes: DataFrame, route: str = "route") -> DataFrame:
    """Attach departure and destination by route name."""
    return df.join(routes.select(route, "departure", "destination"), route, "left")


def split_cached(df: DataFrame, store: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(already labelled, to be labelled) by presence in the label store."""
    done = store.select(F.col("notice_id").alias(key))
    return df.join(done, key, "left_semi"), df.join(done, key, "left_anti")


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled set: notices with a label, repeated ids kept, in the fixed 11 columns."""
    label = labels.select(F.col("notice_id").alias("id"), "criticality", "score", "reason")
    joined = df.withColumn("classification", tx.strip_enum(F.col("classification"))).join(label, "id")
    return joined.select(*domain.LABELED_COLUMNS)


def align_features(labels: DataFrame, embeddings: DataFrame, key: str = "id") -> DataFrame:
    """Labels joined with vectors on the id, never by row position."""
    return labels.join(embeddings, key)


def rare_airports(
    top: DataFrame, everything: DataFrame, threshold: int = 5, place: str = "icao_location",
) -> DataFrame:
    """Top rows with the number of notices at their airport and a rarity flag; unknown airport counts 0."""
    counts = everything.dropna(subset=[place]).groupBy(place).agg(F.count(F.lit(1)).alias("airport_total"))
    return (
        top.join(counts, place, "left")
        .withColumn("airport_total", F.coalesce("airport_total", F.lit(0)))
        .withColumn("likely_rare", F.col("airport_total") < threshold)
    )


def rare_share(flagged: DataFrame) -> DataFrame:
    """Content-driven and rare-airport shares over the rows there are."""
    n = F.count(F.lit(1))
    rare = F.count_if("likely_rare")
    return flagged.agg(
        (n - rare).alias("content_driven"), rare.alias("rare_driven"),
        F.round((n - rare) * 100.0 / n, 6).alias("content_pct"), F.round(rare * 100.0 / n, 6).alias("rare_pct"),
    )
