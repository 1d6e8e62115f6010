"""Closed-form map projections as column expressions (angles in degrees in, metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the Brazilian polyconic grid parameters.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
CENTRAL_MERIDIAN, FALSE_EASTING, FALSE_NORTHING = -54.0, 5_000_000.0, 10_000_000.0

E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)


def _meridian_arc(lat: Column) -> Column:
    e4, e6 = E2**2, E2**3
    return SEMI_MAJOR * (
        (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat
        - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * lat)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * lat)
        - (35 * e6 / 3072) * F.sin(6 * lat)
    )


def polyconic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing on the American polyconic projection with origin on the equator."""
    phi, dlam = F.radians(lat), F.radians(lon - F.lit(CENTRAL_MERIDIAN))
    sin_phi = F.sin(phi)
    radius = F.lit(SEMI_MAJOR) / F.sqrt(1 - F.lit(E2) * sin_phi * sin_phi)
    cot_radius = radius * F.cos(phi) / F.when(sin_phi != 0, sin_phi)
    turn = dlam * sin_phi
    east = F.when(sin_phi == 0, F.lit(SEMI_MAJOR) * dlam).otherwise(cot_radius * F.sin(turn))
    north = F.when(sin_phi == 0, F.lit(0.0)).otherwise(_meridian_arc(phi) + cot_radius * (1 - F.cos(turn)))
    return east + FALSE_EASTING, north + FALSE_NORTHING


def _equal_area_y(lat: Column) -> Column:
    """Ordinate of the cylindrical equal-area projection, in metres."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return q * SEMI_MAJOR / 2


def spheroid_area_m2(geom: Column) -> Column:
    """Area on the ellipsoid: shoelace after an equal-area projection."""

    def ring_area(pts: Column) -> Column:
        xs = F.transform(pts, lambda p: F.radians(p["x"] - pts[0]["x"]) * SEMI_MAJOR)
        ys = F.transform(pts, lambda p: _equal_area_y(p["y"]) - _equal_area_y(pts[0]["y"]))
        return F.abs(
            F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1))),
                F.lit(0.0),
                lambda acc, i: acc
                + F.coalesce(F.get(xs, i - 1) * F.get(ys, i) - F.get(xs, i) * F.get(ys, i - 1), F.lit(0.0)),
            )
        ) / 2

    return F.aggregate(
        geom["rings"],
        F.lit(0.0),
        lambda acc, r: acc + F.when(r["hole"], -1.0).otherwise(1.0) * ring_area(r["pts"]),
    )


def distance_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / 1000.0
