"""Inputs that earlier gave wrong answers: nulls, foreign airports, bad pages, half-written stores, one batch per route."""

import json

import pytest
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.models import iforest
from noticewing.operators import ranking, spatial
from noticewing.plans import order, workflows
from noticewing.sources import airports, labels, pages


def test_null_routes_and_positions_keep_their_rows(spark):
    rows = [("r", 5, 1), ("r", 5, None), (None, 7, 3), (None, None, 4), ("r", 9, 2)]
    df = spark.createDataFrame(rows, "route string, rule_score int, input_pos long")
    got = {(r["route"], r["rule_score"], r["input_pos"]): r["rank"] for r in ranking.rank_notices(df, "route").collect()}
    assert got == {("r", 9, 2): 1, ("r", 5, 1): 2, ("r", 5, None): 3, (None, 7, 3): 1, (None, None, 4): 2}
    assert [r["input_pos"] for r in ranking.rank_notices(df.where("route = 'r'")).collect()] == [2, 1, None]


def test_waypoint_comes_before_any_position(spark):
    df = spark.createDataFrame([("r", 5, 1, 3), ("r", 5, 0, 1 << 52)], "route string, rule_score int, wp_idx int, pos long")
    got = {r["wp_idx"]: r["rank"] for r in ranking.rank_notices(df, "route", ("wp_idx", "pos")).collect()}
    assert got == {0: 1, 1: 2}


def test_flags_by_route(spark):
    rows = [(r, i, float(i + (1000 if r == "b" else 0))) for r in ("a", "b") for i in range(100)] + [(None, 0, 5.0), ("a", 200, None)]
    df = spark.createDataFrame(rows, "route string, i int, anomaly_score double")
    got = iforest.flag(df, by="route").where("is_anomaly").groupBy("route").count().collect()
    assert {r["route"]: r["count"] for r in got} == {"a": 5, "b": 5, None: 1}
    assert iforest.flag(df, by="route").count() == len(rows)


def test_grouped_quantiles_equal_single_ones(spark):
    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 1e18)] + [("b", float(i)) for i in range(9)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in order.exact_quantiles_by(df, "v", [0.0, 0.5, 0.95, 1.0], "g").collect()}
    for g in ("a", "b"):
        for r in order.exact_quantiles(df.where(F.col("g") == g), "v", [0.0, 0.5, 0.95, 1.0]).collect():
            assert got[(g, r["prob"])] == pytest.approx(r["quantile"])
    assert len(got) == 8


def test_only_whole_successes_pass_page_atomic(spark):
    body = {"pageSize": 1, "pageNum": 1, "totalCount": 0, "totalPages": 1, "items": []}
    item = {"x": 1}
    rows = [("q", 429, json.dumps({**body, "items": [item]})), ("q", 200, json.dumps({"items": [item]}))]
    items = pages.page_items(spark.createDataFrame(rows, pages.LANDED))
    assert items.where("page_ok").count() == 0 and pages.validate_items(items, page_atomic=True)[1].count() == items.count() == 2


def test_empty_quoted_fields_are_fields(spark):
    n = len(domain.AIRPORT_COLUMNS)
    good = ",".join(['1', '"X, Y"', '""', ""] + ["a"] * (n - 4))
    last = ",".join(["2"] + ["a"] * (n - 2) + [""])
    lines = spark.createDataFrame([(good,), (last,), (",".join(["3"] * (n + 1)),), (",".join(["4"] * (n - 1)),)], "value string")
    valid, bad = airports.ingest_airports(lines, strict_split=False)
    assert sorted(r["airport_id"] for r in valid.collect()) == [1.0, 2.0] and bad.count() == 2
    assert valid.where("airport_id = 1").first()["name"] == "X, Y"


def test_the_first_airport_with_a_code_decides(spark):
    schema = "pos int, name string, country string, iata string, icao string, lat double, lon double, tz_name string"
    rows = [(0, "abroad", "Elsewhere", "AAA", "XAAA", 1.0, 1.0, None), (1, "home", "United States", "AAA", "KAAA", 40.0, -90.0, None),
            (2, "other", "United States", "BBB", "KBBB", 41.0, -91.0, None)]
    routes = spark.createDataFrame([("x", "AAA", "BBB"), ("y", "KAAA", "BBB")], "route_id string, departure string, destination string")
    notices = spark.createDataFrame(
        [(1, "n", 40.0, -90.0, "t", "R", "N", "DOM", "A", "A")],
        "pos long, id string, lat double, lon double, text string, type string, purpose string, classification string, series string, scope string")
    ranked, rejected = workflows.route_notices(routes, spark.createDataFrame(rows, schema), notices)
    assert [r["route_id"] for r in rejected.collect()] == ["x"] and [r["route_id"] for r in ranked.collect()] == ["y"]


def test_half_written_versions_are_passed_over(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("a", "HIGH", 9, "r")], "notice_id string, criticality string, score int, reason string")
    assert labels.load_store(spark, root).count() == 0
    labels.save_store(df, root)
    df.limit(0).write.parquet(f"{root}/version=1")
    (tmp_path / "store" / "version=1" / "_SUCCESS").unlink()
    assert labels.load_store(spark, root).count() == 1
    labels.save_store(df.unionByName(df.withColumn("notice_id", F.lit("b"))), root)
    assert labels.load_store(spark, root).count() == 2


def test_every_full_cell_is_split(spark):
    notices = spark.range(0, 24_000).select(F.col("id").alias("pos"), (F.col("id") % 120 * 0.7).alias("lat"), (F.floor(F.col("id") / 120) % 100 * 0.8).alias("lon"))
    points = spark.range(1).select(F.col("id").alias("p"), F.lit(7.0).alias("point_lat"), F.lit(8.0).alias("point_lon"))
    found = spatial.radius_join(notices, points, 30.0, rows_per_cell=1)
    near = notices.where("lat BETWEEN 6.4 AND 7.6 AND lon BETWEEN 7.4 AND 8.6")
    assert found.count() == near.where("abs(lat - 7.0) < 0.01 AND abs(lon - 8.0) < 0.01").count() > 1


def test_a_tree_without_enough_rows_is_an_error(spark):
    same = spark.range(2000).select(F.lit(1).alias("id"), F.array(F.rand(1)).alias("embedding"))  # one key: drawn by few trees, then whole
    with pytest.raises(Exception, match="drew"):
        iforest.grow_forest(same, "embedding", "id", 5, 256, 42)
