"""UTM in column expressions: Krueger's series in the third flattening, to n^4 (well under a millimetre)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 and UTM.
A, FLAT, K0, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_n = FLAT / (2 - FLAT)
_E = math.sqrt(FLAT * (2 - FLAT))
_R = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_alpha = [_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440, 61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280]
_beta = [_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440, 17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280]
_delta = [2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45, 56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630]


def zone(lon: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 6.0), F.lit(60)).cast("int") + 1


def epsg(lon: Column, lat: Column) -> Column:
    """326xx in the north, 327xx in the south."""
    return F.when(lat >= 0, 32600).otherwise(32700) + zone(lon)


def forward(lon: Column, lat: Column, z: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in zone z."""
    phi, lam = F.radians(lat), F.radians(lon - (z * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(_alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + K0 * _R * x, K0 * _R * y + F.when(south, FALSE_NORTH).otherwise(0.0)


def inverse(x: Column, y: Column, z: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude from zone z."""
    eta0, xi0 = (x - FALSE_EAST) / (K0 * _R), (y - F.when(south, FALSE_NORTH).otherwise(0.0)) / (K0 * _R)
    xi, eta = xi0, eta0
    for j, b in enumerate(_beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return z * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def project(points: DataFrame, ds: str = "ds") -> DataFrame:
    """PRJ2: x and y in the UTM zone of each log's median position, and its epsg.

    The medians are one row per log.
    """
    m = points.groupBy(ds).agg(F.percentile("lon", F.lit(0.5)).alias("_lon"), F.percentile("lat", F.lit(0.5)).alias("_lat"))
    p = points.join(m.select(ds, zone(F.col("_lon")).alias("_z"), (F.col("_lat") < 0).alias("_s"), epsg(F.col("_lon"), F.col("_lat")).alias("epsg")), ds)
    x, y = forward(F.col("lon"), F.col("lat"), F.col("_z"), F.col("_s"))
    return p.withColumns({"x": x, "y": y}).drop("_z", "_s")


def to_lonlat(points: DataFrame) -> DataFrame:
    """PRJ3: lon and lat from x, y and epsg."""
    south = F.col("epsg") >= 32700
    lon, lat = inverse(F.col("x"), F.col("y"), F.pmod("epsg", F.lit(100)), south)
    return points.withColumns({"lon": lon, "lat": lat})


def align(points: DataFrame, target: DataFrame, ds: str = "ds") -> DataFrame:
    """YR5: points (ds, x, y, epsg) in the UTM zone of each log's target (ds, epsg); those of that zone stay as they are."""
    p = points.join(target.select(ds, F.col("epsg").alias("_to")), ds)
    # columns of their own in between: put into one another, the two series would be a tree of millions of nodes
    lon, lat = inverse(F.col("x"), F.col("y"), F.pmod("epsg", F.lit(100)), F.col("epsg") >= 32700)
    p = p.withColumns({"_lon": lon, "_lat": lat})
    x, y = forward(F.col("_lon"), F.col("_lat"), F.pmod("_to", F.lit(100)), F.col("_to") >= 32700)
    p = p.withColumns({"_x": x, "_y": y})
    same = F.col("epsg") == F.col("_to")
    p = p.withColumns({"x": F.when(same, F.col("x")).otherwise(F.col("_x")), "y": F.when(same, F.col("y")).otherwise(F.col("_y")), "epsg": F.col("_to")})
    return p.drop("_lon", "_lat", "_x", "_y", "_to")


def looks_geographic(points: DataFrame, x: str = "x", y: str = "y", ds: str = "ds") -> DataFrame:
    """SRC4: whether a log's coordinates are degrees."""
    return points.groupBy(ds).agg(((F.max(F.abs(x)) <= 180) & (F.max(F.abs(y)) <= 90)).alias("geographic"))


def metre_factor(lat: Column) -> Column:
    """SRC20: metres of a degree of longitude at a latitude."""
    return F.cos(F.radians(lat)) * 111_320.0
