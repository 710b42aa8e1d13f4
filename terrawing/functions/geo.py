"""Geodesy on WGS84 as column expressions: degrees and metres in, metres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * F.lit(1 - E2) + alt) * F.sin(p)


def ecef_to_enu(xyz: tuple[Column, Column, Column], lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    x0, y0, z0 = geodetic_to_ecef(lat0, lon0, alt0)
    dx, dy, dz = xyz[0] - x0, xyz[1] - y0, xyz[2] - z0
    p, q = F.radians(lat0), F.radians(lon0)
    return (
        -F.sin(q) * dx + F.cos(q) * dy,
        -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz,
        F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz,
    )


def enu_to_ecef(enu: tuple[Column, Column, Column], lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    x0, y0, z0 = geodetic_to_ecef(lat0, lon0, alt0)
    e, n, u = enu
    p, q = F.radians(lat0), F.radians(lon0)
    return (
        x0 - F.sin(q) * e - F.sin(p) * F.cos(q) * n + F.cos(p) * F.cos(q) * u,
        y0 + F.cos(q) * e - F.sin(p) * F.sin(q) * n + F.cos(p) * F.sin(q) * u,
        z0 + F.cos(p) * n + F.sin(p) * u,
    )


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 5) -> Column:
    """struct<lat, lon, alt>; the latitude converges in a fixed number of rounds, folded over a sequence so that the expression stays small."""
    r = F.sqrt(x * x + y * y)

    def step(state: Column, _: Column) -> Column:
        lat = state["lat"]
        n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(lat) * F.sin(lat))
        alt = r / F.cos(lat) - n
        return F.struct(F.atan2(z, r * (1 - F.lit(E2) * n / (n + alt))).alias("lat"), alt.alias("alt"))

    start = F.struct(F.atan2(z, r * F.lit(1 - E2)).alias("lat"), F.lit(0.0).alias("alt"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.struct(F.degrees(done["lat"]).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), done["alt"].alias("alt"))


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60, and 61 for a longitude of exactly 180; no polar or Norwegian exceptions."""
    return F.floor((lon + 180.0) / 6.0).cast("bigint") + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)
