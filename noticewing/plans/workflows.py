"""The end-to-end jobs: brief routes, build the labelled set, train, score a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.models import classify, embed, iforest, split
from noticewing.operators import dedupe, filters, lookup, metrics, profile, ranking, spatial
from noticewing.plans import storage
from noticewing.sources import briefs, labels
from noticewing.sources.models import Models

RESULT = (
    "notice_id", "text", "lr_criticality", "lr_confidence", "rf_criticality", "rf_confidence",
    "anomaly_score", "is_anomaly", "models_agree", "final_criticality",
)


def route_notices(
    routes: DataFrame, airports: DataFrame, notices: DataFrame, gap_miles: float = 40.0, radius_nm: float = 30.0,
    country_values=("United States",),
) -> tuple[DataFrame, DataFrame]:
    """(ranked notices per route, routes that were rejected).

    Routes (route_id, departure, destination) are resolved and checked, waypoints laid, notices joined
    by distance, repeats along a route dropped at the first waypoint, and the rest ranked by the rules.
    """
    found = routes
    for code, end in (("departure", "dep"), ("destination", "dst")):
        # The first airport with the code decides, and then has to lie inside.
        found, _ = lookup.lookup_airports(found, airports, code=code, info=("lat", "lon", "country", "tz_name"))
        found = filters.conus(found, country_values).drop("country", "tz_name").withColumnsRenamed({"lat": f"{end}_lat", "lon": f"{end}_lon"})
    rejected = routes.join(found.select("route_id"), "route_id", "left_anti")
    points = spatial.waypoints(found, gap_miles=gap_miles).withColumnsRenamed({"lat": "point_lat", "lon": "point_lon"})
    slim = notices.select("id", "pos", "lat", "lon")
    near = spatial.radius_join(slim, points, radius_nm)
    # first waypoint that meets a notice, per route: numbers only, so the text is joined once afterwards
    first = near.groupBy("route_id", "id").agg(F.min("wp_idx").alias("wp_idx"))
    ranked = ranking.rank_notices(first.join(notices, "id"), "route_id", ("wp_idx", "pos"))
    return ranked, rejected


def build_labeled(
    route_blocks: list[DataFrame], store: DataFrame, ask: Callable[[DataFrame], DataFrame], order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(labelled set, updated label store) from parsed route datasets in route order.

    `ask` turns the notices without a label into landed attempts (notice_id, attempt, status, reply).
    """
    merged = dedupe.keep_first(dedupe.union_routes(route_blocks), "id", ["route_no", *order])
    _hits, todo = lookup.split_cached(merged, store)
    # Written once: the answers are read more than once, and a service is asked once.
    fresh = dedupe.first_success(storage.written(ask(todo))).drop("attempt")
    known = labels.upsert_labels(store, fresh)
    failed = fresh.where(F.col("reason").startswith(domain.FAILED_PREFIX)).join(store.select("notice_id"), "notice_id", "left_anti")
    return lookup.attach_labels(merged, known.unionByName(failed)), known


def train_all(labeled: DataFrame, encoder: embed.Encoder, key: str = "id", **forest) -> tuple[Models, DataFrame]:
    """(models, metrics of both classifiers on the same held-out rows)."""
    # written first: the split goes through its rows several times, and `labeled` is a plan of joins
    usable = storage.written(filters.trainable(labeled).select(key, "text", "criticality"))
    parts = split.stratified_split(usable, key=key).persist()
    try:
        train, test = parts.where(~F.col("is_test")), parts.where(F.col("is_test"))
        linear = classify.fit_lr(train, key=key)
        vectors = encoder(parts).persist()
        try:
            rf = classify.fit_rf(vectors.where(~F.col("is_test")), key=key, **forest)
            isolation = iforest.IsolationForestModel.fit(vectors, key=key)
            scores = metrics.model_metrics(classify.predict_with(linear, key)(test), "TF-IDF + Logistic Regression", y_true="criticality").unionByName(
                metrics.model_metrics(
                    classify.predict_with(rf, key)(vectors.where(F.col("is_test"))), "Embeddings + Random Forest", y_true="criticality"
                )
            )
            scores = labeled.sparkSession.createDataFrame(scores.collect(), scores.schema)  # two rows
        finally:
            vectors.unpersist()
    finally:
        parts.unpersist()
    return Models(linear, rf, isolation), scores


def scores(df: DataFrame, models: Models, encoder: embed.Encoder, key: str = "id", pos: str = "pos") -> DataFrame:
    """Both classifiers' levels and the raw anomaly score of every notice that is not cancelled, written once."""
    active = filters.active_only(df.select(key, "text", pos))
    linear = models.linear.transform(active, key).select(
        key, F.col("criticality").alias("lr_criticality"), F.bround("confidence", 3).alias("lr_confidence")
    )
    vectors = encoder(active)
    forest = models.forest.transform(vectors).withColumnsRenamed({"criticality": "rf_criticality", "confidence": "rf_confidence"})
    scored = models.isolation.transform(forest).drop("embedding").withColumn("rf_confidence", F.bround("rf_confidence", 3))
    return storage.written(profile.consensus(scored.join(linear, key)).withColumnRenamed(key, "notice_id"))


def score_batch(df: DataFrame, models: Models, encoder: embed.Encoder, key: str = "id", pos: str = "pos") -> DataFrame:
    """Ten result columns plus the input position for every notice that is not cancelled; one batch."""
    flagged = iforest.flag(scores(df, models, encoder, key, pos), mode="batch_percentile")
    return flagged.withColumn("anomaly_score", F.bround("anomaly_score", 4)).select(pos, *RESULT)


def brief_routes(ranked: DataFrame, models: Models, encoder: embed.Encoder, routes: DataFrame, generated_at: str | None = None) -> DataFrame:
    """Briefing lines of ranked route notices; each distinct notice is scored once, each route is a batch of its own."""
    distinct = dedupe.keep_first(ranked.select("id", "text", "pos"), "id", ["pos"])
    scored = scores(distinct, models, encoder).drop("pos", "text")
    named = routes.select("route_id", "departure", "destination")
    rows = ranked.select("route_id", F.col("id").alias("notice_id"), F.col("rank").cast("long").alias("pos"), "text")
    flagged = iforest.flag(rows.join(scored, "notice_id"), mode="batch_percentile", by="route_id")
    joined = flagged.join(named, "route_id").withColumnRenamed("route_id", "route")
    return briefs.brief_lines(joined, generated_at)
