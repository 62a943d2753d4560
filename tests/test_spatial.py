import math
import random

import numpy as np
import pytest

from noticewing.functions import geo
from noticewing.operators import lookup, spatial

JFK, LAX = (40.63980103, -73.77890015), (33.94250107, -118.4079971)
ROUTE = "route_id int, dep_lat double, dep_lon double, dst_lat double, dst_lon double"


def _route(spark, a=JFK, b=LAX):
    return spark.createDataFrame([(1, *a, *b)], ROUTE)


def test_length_and_bearing(spark):
    row = spatial.route_length(_route(spark)).first()
    assert row["distance_miles"] == pytest.approx(2474.884, abs=1e-3)
    assert row["bearing"] == pytest.approx(-86.110, abs=1e-3)


@pytest.mark.parametrize("n", [0, 1, 5, 10, 150, 4444])
def test_waypoint_count_and_uniqueness(spark, n):
    points = spatial.waypoints(_route(spark), n=n).orderBy("wp_idx").collect()
    assert len(points) == n + 2 and len({(p["lat"], p["lon"]) for p in points}) == n + 2
    assert (points[0]["lat"], points[0]["lon"]) == JFK and (points[-1]["lat"], points[-1]["lon"]) == LAX


def test_waypoints_are_even_and_follow_the_geodesic(spark):
    p = spatial.waypoints(_route(spark), gap_miles=40.0).orderBy("wp_idx").toPandas()
    assert len(p) == 63
    step, _ = geo.inverse(p["lat"][:-1], p["lon"][:-1], p["lat"][1:], p["lon"][1:])
    assert np.ptp(step) < 0.01
    _, bearing = geo.inverse([JFK[0]] * 61, [JFK[1]] * 61, p["lat"][1:-1], p["lon"][1:-1])
    assert np.abs(bearing + 86.110).max() < 1


def test_nearly_antipodal_ends(spark):
    # Karney, Algorithms for geodesics (2013), and half a meridian
    metres, bearing = geo.inverse([-30.0, 0.0, 0.0, JFK[0]], [0.0, 0.0, 0.0, JFK[1]], [29.9, 0.5, 0.0, LAX[0]], [179.8, 179.7, 180.0, LAX[1]])
    assert metres[:3] == pytest.approx([19989832.827610, 19944127.421, 20003931.4586], abs=1e-3)
    assert bearing[0] == pytest.approx(161.890524736, abs=1e-6) and metres[3] / geo.METRES_PER_MILE == pytest.approx(2474.884, abs=1e-3)
    points = spatial.waypoints(_route(spark, (0.0, 0.0), (0.5, 179.7)), n=3).orderBy("wp_idx").toPandas()
    assert len(points) == 5 and points["lat"].iloc[2] > 70 and points["lon"].iloc[-1] == 179.7
    row = spatial.route_length(_route(spark, (0.0, 0.0), (0.3, 179.7))).first()
    assert row["distance_miles"] * geo.METRES_PER_MILE == pytest.approx(19965251.4086, abs=1e-2)


def test_same_airport_and_bad_gap(spark):
    assert spatial.waypoints(_route(spark, JFK, JFK), n=7).count() == 1
    for gap in (0, -1.0):
        with pytest.raises(ValueError):
            spatial.waypoints(_route(spark), gap_miles=gap)


def _brute(notices, points, radius):
    out = set()
    for pos, lat, lon in notices:
        for k, plat, plon in points:
            a, b = math.radians(lat), math.radians(plat)
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(plon - lon) / 2) ** 2
            if 2 * geo.EARTH_NM * math.asin(math.sqrt(min(1.0, h))) <= radius:
                out.add((k, pos))
    return out


@pytest.mark.parametrize("radius, rows_per_cell", [(30.0, 1000), (100.0, 10), (5.0, 3)])
def test_radius_join_equals_brute_force(spark, radius, rows_per_cell):
    rng = random.Random(radius)
    near = [(89.6, 10.0), (-89.9, 0.0), (10.0, 179.95), (10.0, -179.97), (40.0, -75.0), (0.0, 0.0)]
    notices = [(i, *(round(c + rng.uniform(-1.5, 1.5), 4) for c in near[i % len(near)])) for i in range(600)]
    notices = [(i, max(-90.0, min(90.0, la)), (lo + 540) % 360 - 180) for i, la, lo in notices]
    notices += [(1000 + i, 40.0, -75.0) for i in range(300)]  # one hot cell
    points = [(k, *near[k % len(near)]) for k in range(12)] + [(20, 90.0, 0.0), (21, -90.0, 50.0)]
    n = spark.createDataFrame(notices, "pos long, lat double, lon double")
    p = spark.createDataFrame(points, "k int, point_lat double, point_lon double")
    joined = spatial.radius_join(n, p, radius, rows_per_cell=rows_per_cell)
    rows = [(r["k"], r["pos"]) for r in joined.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _brute(notices, points, radius)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_radius_bounds(spark):
    n = spark.createDataFrame([(1, 1.0, 1.0)], "pos long, lat double, lon double")
    p = spark.createDataFrame([(1.0, 1.0)], "point_lat double, point_lon double")
    for bad in (0, -1, 100.1):
        with pytest.raises(ValueError):
            spatial.radius_join(n, p, bad)


def test_sampling_grid(spark):
    box = spark.createDataFrame([(48.0, -124.0, 33.0, -80.0)], "lat0 double, lon0 double, lat1 double, lon1 double")
    rows = spatial.sampling_grid(box, 4).collect()
    assert len(rows) == 16 and {r["lat"] for r in rows} == {48.0, 43.0, 38.0, 33.0}
    one = spatial.sampling_grid(box, 1).first()
    assert (one["lat"], one["lon"]) == (33.0, -80.0)


def test_lookup_first_in_file_order_and_missing(spark):
    places = spark.createDataFrame(
        [(0, "Kennedy", "United States", "JFK", "KJFK", *JFK, 13, "America/New_York"), (1, "Other", "X", "JFK", "KXXX", 0.0, 0.0, 1, None),
         (2, "Leeward", "Cuba", "NBW", "MUGM", 19.9, -75.2, 56, None), (3, "Bromont", "Canada", None, "CYAV", 45.2, -72.7, 375, None)],
        "pos int, name string, country string, iata string, icao string, lat double, lon double, elevation int, tz_name string",
    )
    codes = spark.createDataFrame([("JFK",), ("KJFK",), ("MUGM",), ("CYAV",), ("ZZZ",), ("jfk",)], "code string")
    found, rejects = lookup.lookup_airports(codes, places)
    got = {r["code"]: r for r in found.collect()}
    assert got["JFK"]["name"] == got["KJFK"]["name"] == "Kennedy"
    assert got["MUGM"]["tz_name"] is None and got["CYAV"]["iata"] is None
    assert {r["code"] for r in rejects.collect()} == {"ZZZ", "jfk"}
    with pytest.raises(Exception, match="ZZZ"):
        lookup.lookup_airports(codes.where("code = 'ZZZ'"), places, on_missing="raise").collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
