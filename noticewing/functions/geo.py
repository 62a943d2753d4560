"""Distances on the sphere (JVM expressions) and on the WGS-84 ellipsoid (Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_NM = 3440.065  # mean radius
METRES_PER_MILE = 1609.344
# WGS-84
_A = 6378137.0
_F = 1 / 298.257223563
_B = _A * (1 - _F)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    h = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    )
    return F.lit(2.0 * EARTH_NM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _series(cos_sq):
    """Vincenty's A and B for a squared cosine of the azimuth at the equator."""
    u_sq = cos_sq * (_A**2 - _B**2) / _B**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    return big_a, big_b


def _delta_sigma(big_b, sin_s, cos_s, cos_2m):
    return big_b * sin_s * (
        cos_2m
        + big_b / 4 * (
            cos_s * (-1 + 2 * cos_2m**2)
            - big_b / 6 * cos_2m * (-3 + 4 * sin_s**2) * (-3 + 4 * cos_2m**2)
        )
    )


def inverse(lat1, lon1, lat2, lon2, rounds: int = 200):
    """(metres, initial bearing in degrees) on WGS-84 by Vincenty's inverse formula, vectorised.

    Nearly antipodal pairs, where the iteration does not settle, are solved from the direct formula.
    """
    lat1, lon1, lat2, lon2 = (np.asarray(v, dtype="float64") for v in (lat1, lon1, lat2, lon2))
    u1, u2 = (np.arctan((1 - _F) * np.tan(np.radians(v))) for v in (lat1, lat2))
    diff = np.radians((lon2 - lon1 + 540.0) % 360.0 - 180.0)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    same = (lat1 == lat2) & (diff == 0)
    lam = diff.copy()
    settled = same.copy()
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, cu1 * cu2 * sl / sin_s)
            cos_sq = 1 - sin_a**2
            cos_2m = np.where(cos_sq == 0, 0.0, cos_s - 2 * su1 * su2 / cos_sq)
            c = _F / 16 * cos_sq * (4 + _F * (4 - 3 * cos_sq))
            new = diff + (1 - c) * _F * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (-1 + 2 * cos_2m**2)))
            # sigma and the azimuth belong to the longitude before the last step, so one more round follows
            finished = settled.all()
            settled = same | (np.abs(new - lam) < 1e-13)
            lam = new
            if finished:
                break
        big_a, big_b = _series(cos_sq)
        metres = _B * big_a * (sigma - _delta_sigma(big_b, sin_s, cos_s, cos_2m))
        bearing = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
    metres, bearing = np.where(same, 0.0, metres), np.where(same, 0.0, bearing)
    given = np.isfinite(lat1) & np.isfinite(lon1) & np.isfinite(lat2) & np.isfinite(lon2)
    open_ = np.flatnonzero(np.atleast_1d(~settled & given))
    if len(open_):
        flat = [np.atleast_1d(v).astype("float64") for v in np.broadcast_arrays(lat1, lon1, lat2, lon2, metres, bearing)]
        shape = np.shape(flat[4]) if np.ndim(metres) else ()
        flat[4][open_], flat[5][open_] = _far_inverse(*(v[open_] for v in flat[:4]))
        metres, bearing = flat[4].reshape(shape), flat[5].reshape(shape)
    return np.where(settled | given, metres, np.nan), np.where(settled | given, bearing, np.nan)


def _far_inverse(lat1, lon1, lat2, lon2, starts: int = 24, rounds: int = 60):
    """(metres, bearing) of nearly antipodal pairs: the shortest geodesic whose end meets the target.

    Newton steps on bearing and length of the direct formula from bearings all around; of those that
    meet the target the shortest counts. Pairs that none meets are NaN.
    """
    n = len(lat1)
    bearing = np.tile((np.arange(starts) + 0.5) * 360.0 / starts, (n, 1))
    metres = np.full((n, starts), np.pi * _B * 0.999)
    at = [np.repeat(v[:, None], starts, axis=1) for v in (lat1, lon1, lat2, lon2)]

    def miss(b, m):
        lat, lon = direct(at[0], at[1], b, m)
        turn = (lon - at[3] + 540.0) % 360.0 - 180.0
        return np.radians(lat - at[2]) * _A, np.radians(turn) * np.cos(np.radians(at[2])) * _A

    with np.errstate(all="ignore"):
        for _ in range(rounds):
            y, x = miss(bearing, metres)
            yb, xb = miss(bearing + 1e-4, metres)
            ym, xm = miss(bearing, metres + 10.0)
            a, b, c, d = (yb - y) / 1e-4, (ym - y) / 10.0, (xb - x) / 1e-4, (xm - x) / 10.0
            det = a * d - b * c
            turn, go = (-y * d + b * x) / det, (-a * x + c * y) / det
            bearing = bearing + np.nan_to_num(np.clip(turn, -10, 10))
            metres = np.clip(metres + np.nan_to_num(np.clip(go, -2e5, 2e5)), 0.9 * np.pi * _B, 1.01 * np.pi * _A)
        y, x = miss(bearing, metres)
    met = np.where(np.hypot(x, y) < 1e-2, metres, np.inf)
    best = met.argmin(axis=1)
    row = np.arange(n)
    found = np.isfinite(met[row, best])
    turned = (bearing[row, best] + 540.0) % 360.0 - 180.0
    return np.where(found, met[row, best], np.nan), np.where(found, turned, np.nan)


def direct(lat1, lon1, bearing, metres, rounds: int = 100):
    """(lat, lon) reached from a point on an initial bearing, by Vincenty's direct formula, vectorised."""
    lat1, lon1, bearing, metres = (np.asarray(v, dtype="float64") for v in (lat1, lon1, bearing, metres))
    az = np.radians(bearing)
    tan_u = (1 - _F) * np.tan(np.radians(lat1))
    cu = 1 / np.sqrt(1 + tan_u**2)
    su = tan_u * cu
    s1 = np.arctan2(tan_u, np.cos(az))
    sin_a = cu * np.sin(az)
    cos_sq = 1 - sin_a**2
    big_a, big_b = _series(cos_sq)
    base = metres / (_B * big_a)
    sigma = base.copy()
    for _ in range(rounds):
        new = base + _delta_sigma(big_b, np.sin(sigma), np.cos(sigma), np.cos(2 * s1 + sigma))
        done = np.abs(new - sigma) < 1e-14
        sigma = new
        if np.all(done):
            break
    ss, cs, cos_2m = np.sin(sigma), np.cos(sigma), np.cos(2 * s1 + sigma)
    lat2 = np.arctan2(
        su * cs + cu * ss * np.cos(az), (1 - _F) * np.hypot(sin_a, su * ss - cu * cs * np.cos(az))
    )
    lam = np.arctan2(ss * np.sin(az), cu * cs - su * ss * np.cos(az))
    c = _F / 16 * cos_sq * (4 + _F * (4 - 3 * cos_sq))
    diff = lam - (1 - c) * _F * sin_a * (sigma + c * ss * (cos_2m + c * cs * (-1 + 2 * cos_2m**2)))
    lon2 = (lon1 + np.degrees(diff) + 540.0) % 360.0 - 180.0
    return np.degrees(lat2), lon2


_INVERSE = T.StructType().add("distance_miles", "double").add("bearing", "double")
_DIRECT = T.StructType().add("lat", "double").add("lon", "double")


@F.pandas_udf(_INVERSE)
def inverse_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    metres, bearing = inverse(lat1, lon1, lat2, lon2)
    return pd.DataFrame({"distance_miles": metres / METRES_PER_MILE, "bearing": bearing})


@F.pandas_udf(_DIRECT)
def direct_udf(lat: pd.Series, lon: pd.Series, bearing: pd.Series, miles: pd.Series) -> pd.DataFrame:
    lat2, lon2 = direct(lat, lon, bearing, miles * METRES_PER_MILE)
    return pd.DataFrame({"lat": lat2, "lon": lon2})
