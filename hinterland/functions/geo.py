"""Great-circle geometry as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: equatorial radius in metres. It cancels out of weighted means.
EARTH_RADIUS_M = 6378137.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def great_circle(
    lon1: Column | str,
    lat1: Column | str,
    lon2: Column | str,
    lat2: Column | str,
    radius: float = EARTH_RADIUS_M,
) -> Column:
    """Haversine distance between two points given in degrees."""
    a1, a2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_lat = F.sin((a2 - a1) / 2)
    half_lon = F.sin((F.radians(_col(lon2)) - F.radians(_col(lon1))) / 2)
    h = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def unit_vector(lon: Column | str, lat: Column | str) -> tuple[Column, Column, Column]:
    """Point on the unit sphere. Chord length grows with great-circle distance, so
    comparisons can be made on chords without trigonometry."""
    lam, phi = F.radians(_col(lon)), F.radians(_col(lat))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def distance_weight(
    pop: Column | str, metres: Column | str, decay: float = 2.0, min_dist: float = 1.0
) -> Column:
    """``pop * d ** -decay`` with the distance floored, so that a point on top of
    another gets a finite weight."""
    d = F.greatest(_col(metres), F.lit(float(min_dist)))
    return _col(pop) * F.pow(d, F.lit(-float(decay)))
