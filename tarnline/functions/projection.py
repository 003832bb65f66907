"""Transverse Mercator coordinates as column expressions, and the zones that rasters and networks are projected to.

Krüger's series in the third flattening, to its sixth power: both ways agree with the exact projection to well under a
millimetre within a zone and far beyond. One ellipsoid serves WGS 84 and NAD 83, whose flattenings put points a few tenths of a millimetre apart at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening (fixed values), scale on the central meridian, false easting and northing of the south.
A, FLAT, K0, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLAT / (2 - FLAT)
ECC = math.sqrt(FLAT * (2 - FLAT))
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
#: Codes that name degrees, and those whose last two digits name a zone: of the north, of the south, of the north in NAD 83 (fixed values).
GEOGRAPHIC = (4326, 4269)
NORTH, SOUTHERN, NAD83 = (32601, 32660), (32701, 32760), (26901, 26923)


def _series(rows: tuple[tuple[float, ...], ...]) -> tuple[float, ...]:
    """Coefficients from the factors of the powers of N, the j-th row from the j-th power on."""
    return tuple(sum(c * N ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1))


# fixed values: the published factors of the series
TO_PLANE = _series(((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,)))
TO_SPHERE = _series(((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,)))
TO_LATITUDE = _series(((2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835), (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,)))


def _let(then, **values: Column) -> Column:
    """then(struct of the values), each evaluated once: the series would write them out for every term."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), then)[0]


def _series_sum(start: Column, factors: tuple[float, ...], wave, hyper, xi: Column, eta: Column) -> Column:
    for j, a in enumerate(factors, 1):
        start = start + a * wave(2 * j * xi) * hyper(2 * j * eta)
    return start


def is_projected(epsg: Column) -> Column:
    return epsg.between(*NORTH) | epsg.between(*SOUTHERN) | epsg.between(*NAD83)


def is_known(epsg: Column) -> Column:
    return epsg.isin(*GEOGRAPHIC) | is_projected(epsg)


def meridian(epsg: Column) -> Column:
    """Degrees of a zone's central meridian."""
    return (epsg % 100) * 6.0 - 183.0


def _north0(epsg: Column) -> Column:
    return F.when(epsg.between(*SOUTHERN), SOUTH).otherwise(0.0)


def forward(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Coordinates in a system, of degrees; degrees themselves for geographic systems, null for unknown ones."""

    def sphere(p: Column) -> Column:
        root = F.sqrt(1 + p["tan"] * p["tan"])
        sigma = F.sinh(ECC * F.atanh(ECC * p["tan"] / root))
        return _let(lambda q: plane(p["away"], q["conformal"]), conformal=p["tan"] * F.sqrt(1 + sigma * sigma) - sigma * root)

    def plane(away: Column, conformal: Column) -> Column:
        cos = F.cos(away)
        return _let(lambda p: _let(lambda q: q, x=EAST + K0 * RADIUS * _series_sum(p["eta"], TO_PLANE, F.cos, F.sinh, p["xi"], p["eta"]), y=K0 * RADIUS * _series_sum(p["xi"], TO_PLANE, F.sin, F.cosh, p["xi"], p["eta"])), xi=F.atan2(conformal, cos), eta=F.asinh(F.sin(away) / F.sqrt(conformal * conformal + cos * cos)))

    made = _let(sphere, away=F.radians(lon - meridian(epsg)), tan=F.tan(F.radians(lat)))
    pick = lambda degrees, metres: F.when(epsg.isin(*GEOGRAPHIC), degrees).when(is_projected(epsg), metres)
    return pick(lon, made["x"]), pick(lat, _north0(epsg) + made["y"])


def inverse(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Degrees (longitude, latitude) of coordinates in a system."""

    def sphere(p: Column) -> Column:
        less = tuple(-b for b in TO_SPHERE)
        return _let(ellipsoid, xi=_series_sum(p["xi"], less, F.sin, F.cosh, p["xi"], p["eta"]), eta=_series_sum(p["eta"], less, F.cos, F.sinh, p["xi"], p["eta"]))

    def ellipsoid(p: Column) -> Column:
        return _let(lambda q: _let(lambda r: r, lon=F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])), lat=_series_sum(q["chi"], TO_LATITUDE, F.sin, lambda _: F.lit(1.0), q["chi"], q["chi"])), chi=F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])))

    made = _let(sphere, xi=(y - _north0(epsg)) / (K0 * RADIUS), eta=(x - EAST) / (K0 * RADIUS))
    pick = lambda degrees, metres: F.when(epsg.isin(*GEOGRAPHIC), degrees).when(is_projected(epsg), metres)
    return pick(x, meridian(epsg) + F.degrees(made["lon"])), pick(y, F.degrees(made["lat"]))


def zone(lon: Column, lat: Column) -> Column:
    """The code of the zone that a place lies in (without the exceptions of some coasts)."""
    number = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat < 0, 32700).otherwise(32600) + number).cast("int")
