"""Map projections as column arithmetic: transverse Mercator, Web Mercator, equal-area sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.numbers import fixed
from fieldspark.functions import ring as R

# WGS84 / GRS80 ellipsoid, UTM scale and offsets, Web Mercator and authalic radii.
SEMI_MAJOR = 6378137.0
INV_FLATTENING = 298.257222101
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
AUTHALIC_RADIUS = 6371007.181
METRES_PER_DEGREE = 111320.0

_F = 1.0 / INV_FLATTENING
_N = _F / (2.0 - _F)
_E = math.sqrt(_F * (2.0 - _F))
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krüger series to order four in the third flattening
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def _atanh(v: Column) -> Column:
    return 0.5 * F.log((1 + v) / (1 - v))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """326zz north, 327zz south."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def etrs_epsg(lon: Column) -> Column:
    """25828 to 25831 by longitude band."""
    return F.when(lon < -12, 25828).when(lon < -6, 25829).when(lon < 0, 25830).otherwise(25831)


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def _series(coefficients: tuple[float, ...], xi: Column, eta: Column, sign: int) -> tuple[Column, Column]:
    """``xi`` and ``eta`` with the trigonometric series added (+1) or taken off (−1)."""
    north, east = xi, eta
    for j, c in enumerate(coefficients, 1):
        north = north + F.lit(sign * c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + F.lit(sign * c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return north, east


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """``x,y`` struct in metres."""
    scale = UTM_SCALE * _RECTIFYING
    offset = F.when(lat < 0, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))

    def conformal(s: Column) -> Column:
        return F.sinh(_atanh(s) - F.lit(_E) * _atanh(F.lit(_E) * s))

    # each stage is bound once, so the tree stays small
    start = F.struct(
        R.let(F.sin(F.radians(lat)), conformal).alias("t"), F.radians(lon - central_meridian(zone)).alias("lam")
    )

    def sphere(v: Column) -> Column:
        return F.struct(
            F.atan2(v["t"], F.cos(v["lam"])).alias("xi"),
            R.let(F.sin(v["lam"]) / F.sqrt(1 + v["t"] * v["t"]), _atanh).alias("eta"),
        )

    def plane(v: Column) -> Column:
        north, east = _series(_FORWARD, v["xi"], v["eta"], 1)
        return R.point(F.lit(FALSE_EASTING) + scale * east, scale * north + offset)

    return R.let(R.let(start, sphere), plane)


def from_utm(x: Column, y: Column, zone: Column, south: bool = False) -> Column:
    """``x`` longitude, ``y`` latitude."""
    scale = UTM_SCALE * _RECTIFYING
    start = F.struct(
        ((y - F.lit(FALSE_NORTHING_SOUTH if south else 0.0)) / scale).alias("xi"),
        ((x - F.lit(FALSE_EASTING)) / scale).alias("eta"),
    )

    def sphere(v: Column) -> Column:
        north, east = _series(_INVERSE, v["xi"], v["eta"], -1)
        return F.struct(north.alias("xi"), east.alias("eta"))

    def geodetic(v: Column) -> Column:
        # geodetic latitude from the conformal one, fixed-point iteration on the isometric latitude
        def latitude(q: Column) -> Column:
            sin_phi = F.tanh(q)
            for _ in range(5):
                sin_phi = F.tanh(q + F.lit(_E) * R.let(F.lit(_E) * sin_phi, _atanh))
            return F.degrees(F.asin(sin_phi))

        lon = F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))) + central_meridian(zone)
        return R.point(lon, R.let(R.let(F.sin(v["xi"]) / F.cosh(v["eta"]), _atanh), latitude))

    return R.let(R.let(start, sphere), geodetic)


def to_web_mercator(lon: Column, lat: Column) -> Column:
    return R.point(
        F.lit(SEMI_MAJOR) * F.radians(lon),
        F.lit(SEMI_MAJOR) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)),
    )


def from_web_mercator(x: Column, y: Column) -> Column:
    return R.point(
        F.degrees(x / F.lit(SEMI_MAJOR)),
        F.degrees(2 * F.atan(F.exp(y / F.lit(SEMI_MAJOR))) - F.lit(math.pi / 2)),
    )


def ring_to_utm(ring: Column, zone: Column) -> Column:
    return F.transform(ring, lambda p: to_utm(p["x"], p["y"], zone))


def ring_to_web_mercator(ring: Column) -> Column:
    return F.transform(ring, lambda p: to_web_mercator(p["x"], p["y"]))


def area_planar_ha(ring: Column, zone: int = 30) -> Column:
    """Hectares of a lon/lat ring in the UTM plane, four decimals."""
    return fixed(R.area(ring_to_utm(ring, F.lit(zone))) / 10000.0, 4)


def area_web_mercator(ring: Column) -> Column:
    """Square metres in Web Mercator; grows with latitude."""
    return R.area(ring_to_web_mercator(ring))


def area_degrees_approx(ring: Column) -> Column:
    return R.area(ring) * F.lit(METRES_PER_DEGREE * METRES_PER_DEGREE)


def _authalic_sin(lat: Column) -> Column:
    """Sine of the authalic latitude."""
    pole = (1 - _E**2) * (1 / (1 - _E**2) + math.atanh(_E) / _E)

    def q(v: Column) -> Column:
        return (1 - _E**2) * (v / (1 - F.lit(_E**2) * v * v) + _atanh(F.lit(_E) * v) / F.lit(_E)) / F.lit(pole)

    return R.let(F.sin(F.radians(lat)), q)


def area_geography(ring: Column) -> Column:
    """Ellipsoidal square metres by the cylindrical equal-area map of the authalic sphere.

    Edges are straight in that map, not geodesics; for plots up to a few kilometres the difference is below 1e-6.
    """
    flat = F.transform(
        ring,
        lambda p: R.point(F.lit(AUTHALIC_RADIUS) * F.radians(p["x"]), F.lit(AUTHALIC_RADIUS) * _authalic_sin(p["y"])),
    )
    return R.area(flat)


def densified_box(minx: Column, miny: Column, maxx: Column, maxy: Column, extra: int = 21) -> Column:
    """Border points of a box, with ``extra`` points between the corners of each side."""
    steps = F.sequence(F.lit(0), F.lit(extra + 1))
    share = lambda i: i.cast("double") / F.lit(float(extra + 1))
    return F.concat(
        F.transform(steps, lambda i: R.point(minx + (maxx - minx) * share(i), miny)),
        F.transform(steps, lambda i: R.point(minx + (maxx - minx) * share(i), maxy)),
        F.transform(steps, lambda i: R.point(minx, miny + (maxy - miny) * share(i))),
        F.transform(steps, lambda i: R.point(maxx, miny + (maxy - miny) * share(i))),
    )


def bbox_reproject(minx: Column, miny: Column, maxx: Column, maxy: Column, zone: Column, extra: int = 21) -> Column:
    """``minx, miny, maxx, maxy`` struct in UTM metres of a lon/lat box."""
    border = ring_to_utm(densified_box(minx, miny, maxx, maxy, extra), zone)
    return R.let(border, lambda r: F.struct(*[v.alias(n) for n, v in R.bounds(r).items()]))
