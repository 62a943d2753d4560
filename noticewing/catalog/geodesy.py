"""Registered queries: geodesic length and waypoints, with the ellipsoid formulas unrolled in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticewing.catalog.registry import query
from noticewing.catalog.views import Views
from noticewing.operators import spatial

A, FLAT = 6378137.0, "(1.0::DOUBLE / 298.257223563::DOUBLE)"
B = f"({A}::DOUBLE * (1 - {FLAT}))"
ROUNDS = 12


def _c(x: str) -> str:
    return f"({FLAT} / 16 * {x} * (4 + {FLAT} * (4 - 3 * {x})))"


def _big(x: str) -> tuple[str, str]:
    u = f"({x} * (({A}::DOUBLE * {A}::DOUBLE) / ({B} * {B}) - 1))"
    return (
        f"(1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))))",
        f"({u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))))",
    )


def _delta(bb: str, ss: str, cs: str, c2: str) -> str:
    return (
        f"({bb} * {ss} * ({c2} + {bb} / 4 * ({cs} * (-1 + 2 * {c2} * {c2}) - {bb} / 6 * {c2} * (-3 + 4 * {ss} * {ss}) * (-3 + 4 * {c2} * {c2}))))"
    )


def inverse_sql(source: str) -> str:
    """Distance in miles and initial bearing per row of `source`, iterated a fixed number of times."""
    q = f"""SELECT *, atan((1 - {FLAT}) * tan(radians(dep_lat))) AS u1, atan((1 - {FLAT}) * tan(radians(dst_lat))) AS u2,
 radians(dst_lon - dep_lon) AS l0, dep_lat = dst_lat AND dep_lon = dst_lon AS still FROM {source}"""
    q = f"SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, l0 AS lam FROM ({q}) q"
    for _ in range(ROUNDS):
        q = f"""SELECT * EXCLUDE (lam, sl, cl), l0 + (1 - c) * {FLAT} * sa * (sg + c * ss * (c2 + c * cs * (-1 + 2 * c2 * c2))) AS lam FROM (
 SELECT *, cs - 2 * su1 * su2 / cq AS c2, {_c('cq')} AS c FROM (SELECT *, 1 - sa * sa AS cq FROM (
 SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sl / ss END AS sa, atan2(ss, cs) AS sg FROM (
 SELECT *, sqrt(pow(cu2 * sl, 2) + pow(cu1 * su2 - su1 * cu2 * cl, 2)) AS ss, su1 * su2 + cu1 * cu2 * cl AS cs FROM (
 SELECT * {'EXCLUDE (ss, cs, sa, sg, cq, c2, c)' if _ else ''}, sin(lam) AS sl, cos(lam) AS cl FROM ({q}) a) b) d) e) f) g"""
    aa, bb = _big("cq")
    return f"""SELECT route_id, dep_lat, dep_lon, dst_lat, dst_lon, still,
 CASE WHEN still THEN 0 ELSE {B} * {aa} * (sg - {_delta(bb, 'ss', 'cs', 'c2')}) / 1609.344 END AS miles,
 CASE WHEN still THEN 0 ELSE degrees(atan2(cu2 * sin(lam), cu1 * su2 - su1 * cu2 * cos(lam))) END AS bearing FROM ({q}) r"""


def waypoints_sql(steps: str) -> str:
    """Points along every flight; `steps` is the number of inner points."""
    q = f"""SELECT *, radians(bearing) AS az, (1 - {FLAT}) * tan(radians(dep_lat)) AS tu, miles / last * 1609.344 * wp_idx AS metres
 FROM (SELECT *, unnest(range(0, last + 1)) AS wp_idx FROM (SELECT *, CASE WHEN still THEN 0 ELSE {steps} + 1 END AS last FROM ({inverse_sql('v_flights')}) i) j) k"""
    q = f"SELECT *, 1 / sqrt(1 + tu * tu) AS cu FROM ({q}) q"
    q = f"SELECT *, tu * cu AS su, atan2(tu, cos(az)) AS s1, cu * sin(az) AS sa FROM ({q}) q"
    q = f"SELECT *, 1 - sa * sa AS cq FROM ({q}) q"
    aa, bb = _big("cq")
    q = f"SELECT *, {bb} AS bb, metres / ({B} * {aa}) AS base, metres / ({B} * {aa}) AS sg FROM ({q}) q"
    for _ in range(8):
        q = f"SELECT * EXCLUDE (sg), base + {_delta('bb', 'sin(sg)', 'cos(sg)', 'cos(2 * s1 + sg)')} AS sg FROM ({q}) q"
    q = f"SELECT *, sin(sg) AS ss, cos(sg) AS cs, cos(2 * s1 + sg) AS c2, {_c('cq')} AS c FROM ({q}) q"
    q = f"""SELECT *, degrees(atan2(su * cs + cu * ss * cos(az), (1 - {FLAT}) * sqrt(sa * sa + pow(su * ss - cu * cs * cos(az), 2)))) AS la,
 dep_lon + degrees(atan2(ss * sin(az), cu * cs - su * ss * cos(az)) - (1 - c) * {FLAT} * sa * (sg + c * ss * (c2 + c * cs * (-1 + 2 * c2 * c2)))) AS lo FROM ({q}) q"""
    return f"""SELECT route_id, CAST(wp_idx AS INT) AS wp_idx,
 round(CASE WHEN wp_idx = 0 THEN dep_lat WHEN wp_idx = last THEN dst_lat ELSE la END, 5) AS lat,
 round(CASE WHEN wp_idx = 0 THEN dep_lon WHEN wp_idx = last THEN dst_lon ELSE lo END, 5) AS lon FROM ({q}) w"""


def _rounded(df):
    return df.select("route_id", "wp_idx", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("route_length", f"SELECT route_id, round(miles, 5) AS distance_miles, round(bearing, 5) AS bearing FROM ({inverse_sql('v_flights')}) t")
def _(v: Views):
    return spatial.route_length(v.flights()).select(
        "route_id", F.round("distance_miles", 5).alias("distance_miles"), F.round("bearing", 5).alias("bearing")
    )


@query("waypoints_by_num", waypoints_sql("5"))
def _(v: Views):
    return _rounded(spatial.waypoints(v.flights(), n=5))


@query("waypoints_by_gap", waypoints_sql("CAST(floor(miles / 40) AS INT)"))
def _(v: Views):
    return _rounded(spatial.waypoints(v.flights(), gap_miles=40.0))
