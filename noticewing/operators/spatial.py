"""Waypoints along geodesics and the radius join of notices to points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewing import domain
from noticewing.functions import geo

#: notices of one grid cell that one join task should hold; fuller cells are split
ROWS_PER_CELL = 200_000


def route_length(routes: DataFrame) -> DataFrame:
    """Add WGS-84 distance_miles (statute) and initial bearing between dep_lat/lon and dst_lat/lon."""
    solved = routes.withColumn("_inv", geo.inverse_udf("dep_lat", "dep_lon", "dst_lat", "dst_lon"))
    return solved.select(*routes.columns, "_inv.distance_miles", "_inv.bearing")


def waypoints(routes: DataFrame, n: int | None = None, gap_miles: float | None = None, key: str = "route_id") -> DataFrame:
    """Equally spaced points per route, both ends included: (key, wp_idx, lat, lon).

    Give `n` inner points, or a gap in statute miles (then n = floor(length / gap)). A route that
    ends where it starts has one point.
    """
    if (n is None) == (gap_miles is None):
        raise ValueError("give either n or gap_miles")
    if gap_miles is not None and gap_miles <= 0:
        raise ValueError("Gap is not a valid number.")
    if n is not None and n < 0:
        raise ValueError("n must not be negative")
    # null comes back for ends that are missing or meet no geodesic; such a route must not vanish silently
    lost = F.col("distance_miles").isNull() | F.isnan("distance_miles")
    inner = F.lit(n) if n is not None else F.floor(F.col("distance_miles") / F.lit(float(gap_miles))).cast("int")
    inner = F.when(lost, F.raise_error(F.lit("the ends of a route are unknown or meet no geodesic"))).otherwise(inner)
    still = (F.col("dep_lat") == F.col("dst_lat")) & (F.col("dep_lon") == F.col("dst_lon"))
    # a narrow route row grows into many points, so routes are spread over the tasks first
    ends = route_length(routes.repartition(key)).withColumn("_last", F.when(still, 0).otherwise(inner + 1))
    stepped = ends.withColumn("wp_idx", F.explode_outer(F.sequence(F.lit(0), F.col("_last"))))
    moved = stepped.withColumn(
        "_at",
        geo.direct_udf(
            "dep_lat", "dep_lon", "bearing",
            F.when(F.col("_last") == 0, 0.0).otherwise(F.col("distance_miles") / F.col("_last") * F.col("wp_idx")),
        ),
    )

    def place(axis: str):
        return (
            F.when(F.col("wp_idx") == 0, F.col(f"dep_{axis}"))
            .when(F.col("wp_idx") == F.col("_last"), F.col(f"dst_{axis}"))
            .otherwise(F.col(f"_at.{axis}")).alias(axis)
        )

    return moved.select(key, "wp_idx", place("lat"), place("lon"))


def _grid(radius_nm: float) -> tuple[float, int]:
    """(cell side in degrees, columns around the globe): a side a little over the radius."""
    columns = max(1, math.floor(360.0 / (radius_nm / 60.0 * 1.01)))
    return 360.0 / columns, columns


def radius_join(
    notices: DataFrame, points: DataFrame, radius_nm: float, spread: str = "pos",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Every (point, notice) pair at most `radius_nm` apart, with distance_nm.

    Points come as lat/lon in columns point_lat, point_lon. A point goes to the grid cells its circle
    can touch, a notice to its own cell, and cells are matched by an equi-join. Cells fuller than
    `rows_per_cell` are split by a hash of `spread`, their points copied once per split.
    """
    if not 0 < radius_nm <= domain.MAX_RADIUS_NM:
        raise ValueError(f"radius must be in (0, {domain.MAX_RADIUS_NM:g}]")
    side, columns = _grid(radius_nm)
    reach = radius_nm / geo.EARTH_NM  # radians

    own = notices.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    own = own.withColumn("_row", F.floor((F.col("lat") + 90.0) / side).cast("int")).withColumn(
        "_col", F.pmod(F.floor((F.col("lon") + 180.0) / side).cast("int"), F.lit(columns))
    )
    # One row per full cell, all of them; joins measure its size themselves.
    hot = (
        own.groupBy("_row", "_col").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_cell)
        .select("_row", "_col", F.ceil(F.col("_n") / rows_per_cell).cast("int").alias("_splits"))
    )
    splits = F.coalesce("_splits", F.lit(1))
    left = own.join(hot, ["_row", "_col"], "left").withColumn(
        "_salt", F.when(F.col("_splits").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), splits).cast("int"))
    ).drop("_splits")

    # Half-width of the circle in longitude; past the pole it covers every column.
    ratio = F.lit(math.sin(reach)) / F.cos(F.radians(F.col("point_lat")))
    polar = (F.abs("point_lat") + math.degrees(reach) * 1.001) >= 90.0
    half = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.001)
    first = F.floor((F.col("point_lon") - half + 180.0) / side).cast("int")
    last = F.floor((F.col("point_lon") + half + 180.0) / side).cast("int")
    last = F.least(last, first + columns - 1)
    margin = math.degrees(reach) * 1.001
    rows = F.sequence(
        F.floor((F.col("point_lat") - margin + 90.0) / side).cast("int"),
        F.floor((F.col("point_lat") + margin + 90.0) / side).cast("int"),
    )
    reached = (
        points.where(F.col("point_lat").isNotNull() & F.col("point_lon").isNotNull())
        .withColumn("_row", F.explode(rows))
        .withColumn("_col", F.explode(F.sequence(first, last)))
        .withColumn("_col", F.pmod(F.col("_col"), F.lit(columns)))
        .join(hot, ["_row", "_col"], "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    return (
        left.join(reached, ["_row", "_col", "_salt"])
        .withColumn("distance_nm", geo.haversine_nm(F.col("lat"), F.col("lon"), F.col("point_lat"), F.col("point_lon")))
        .where(F.col("distance_nm") <= radius_nm)
        .drop("_row", "_col", "_salt")
    )


def sampling_grid(boxes: DataFrame, n: int) -> DataFrame:
    """n x n evenly spaced points per box (lat0, lon0) - (lat1, lon1); n = 1 gives the end corner."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def at(start: str, stop: str, i: str):
        if n == 1:
            return F.col(stop)
        return F.col(start) + (F.col(stop) - F.col(start)) / F.lit(float(n - 1)) * F.col(i)

    return (
        boxes.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
        .withColumn("i", F.floor(F.col("_cell") / n).cast("int")).withColumn("j", (F.col("_cell") % n).cast("int"))
        .withColumn("lat", at("lat0", "lat1", "i")).withColumn("lon", at("lon0", "lon1", "j"))
        .drop("_cell")
    )
