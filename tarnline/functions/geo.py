"""Column expressions on coordinates, grades and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: Terrain classes by the grade in percent that they are above, steepest first (fixed values).
TERRAIN = ((15.0, "very_steep_uphill"), (8.0, "steep_uphill"), (2.0, "uphill"), (-2.0, "level"), (-8.0, "downhill"), (-15.0, "steep_downhill"), (None, "very_steep_downhill"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column, plane: float) -> Column:
    """Metres in the plane in which degrees of longitude are as long as at one latitude."""
    return F.lit(EARTH_M) * F.hypot(F.radians(lat2 - lat1), F.radians(lon2 - lon1) * F.cos(F.radians(F.lit(plane))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.rint(degrees / 45).cast("int") % 8) + 1)


def grade_percent(rise: Column, run: Column) -> Column:
    """Signed grade; 0 without distance."""
    return F.when(run > 0, rise / run * 100).otherwise(0.0)


def terrain(grade: Column) -> Column:
    chain = reduce(lambda c, x: c.when(grade > x[0], x[1]), TERRAIN[1:-1], F.when(grade > TERRAIN[0][0], TERRAIN[0][1]))
    return chain.otherwise(TERRAIN[-1][1])


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def difficulty_score(gain: Column, loss: Column, max_grade: Column, km: Column) -> Column:
    """0 to 100 from steepest grade, gain, loss and roughness per km; 0 without distance."""
    capped = lambda x, full, most: F.least(x / full * most, F.lit(float(most)))
    return F.when(km > 0, capped(max_grade, 15, 30) + capped(gain / km, 50, 40) + capped(loss / km, 50, 20) + capped((gain + loss) / km, 100, 10)).otherwise(0.0)


def distance_score(km: Column, target_km: float) -> Column:
    """1 on the target; a token score outside 15 percent of it."""
    error, tolerance = F.abs(km - target_km), 0.1 * target_km
    near = 1 - error / tolerance * 0.1
    far = F.greatest(F.lit(0.0), 0.9 - F.least(F.lit(0.8), (error - tolerance) / target_km * 3))
    return F.when(km <= 0, 0.0).when(error > 0.15 * target_km, 0.01).when(error <= tolerance, near).otherwise(far)


def elevation_score(gain: Column, max_grade: Column) -> Column:
    penalty = F.when(max_grade > 15, F.least(F.lit(0.3), (max_grade - 15) / 100)).otherwise(0.0)
    return F.when(gain <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.log(1 + gain / 10) / F.log(F.lit(501.0)) - penalty))
