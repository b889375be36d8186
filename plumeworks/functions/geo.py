"""Map projections and distances as column arithmetic. Angles are in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80, and the equal-area conic of the conterminous United States. Fixed values.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN = (29.5, 45.5), (23.0, -96.0)
EARTH_KM = 6371.0088

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(s: float) -> float:
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - _E2 * s * s)


_SIN = [math.sin(math.radians(x)) for x in (*PARALLELS, ORIGIN[0])]
CONE = (_m(PARALLELS[0]) ** 2 - _m(PARALLELS[1]) ** 2) / (_q(_SIN[1]) - _q(_SIN[0]))
CONSTANT = _m(PARALLELS[0]) ** 2 + CONE * _q(_SIN[0])
RHO = AXIS * math.sqrt(CONSTANT - CONE * _q(_SIN[2])) / CONE


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Projected x and y."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = AXIS * F.sqrt(CONSTANT - CONE * q) / CONE
    theta = CONE * F.radians(lon - ORIGIN[1])
    return rho * F.sin(theta), RHO - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column, steps: int = 4) -> tuple[Column, Column]:
    """Longitude and latitude of a projected point."""
    rho = F.sqrt(x * x + (RHO - y) * (RHO - y))
    lon = ORIGIN[1] + F.degrees(F.atan2(x, RHO - y)) / CONE
    q = (CONSTANT - rho * rho * CONE * CONE / AXIS**2) / CONE

    def better(phi: Column, _: Column) -> Column:
        s = F.sin(phi)
        d = 1 - _E2 * s * s
        return phi + d * d / (2 * F.cos(phi)) * (q / (1 - _E2) - s / d + F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))

    # A fold, as the expression would grow with a power of the steps if it were written out.
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.asin(q / 2), better)
    return lon, F.degrees(phi)


def box_bounds(x: Column, y: Column, half: float) -> list[Column]:
    """lon_min, lon_max, lat_min, lat_max of the corners of a projected square."""
    lon, lat = zip(*(albers_inverse(x + dx, y + dy) for dx in (-half, half) for dy in (-half, half)), strict=True)
    return [F.least(*lon).alias("lon_min"), F.greatest(*lon).alias("lon_max"), F.least(*lat).alias("lat_min"), F.greatest(*lat).alias("lat_max")]


def great_circle_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    u = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), u)))


def lambert(lon: Column, lat: Column, parallel: float, lon_0: float, radius: float = 6371229.0) -> tuple[Column, Column]:
    """Spherical conformal conic with one standard parallel."""
    n = math.sin(math.radians(parallel))
    tan = lambda p: F.tan(F.radians(p) / 2 + math.pi / 4)
    f = math.cos(math.radians(parallel)) * math.tan(math.pi / 4 + math.radians(parallel) / 2) ** n / n
    rho = radius * f / F.pow(tan(lat), n)
    theta = n * F.radians(longitude_180(lon - lon_0))
    return rho * F.sin(theta), radius * f / math.tan(math.pi / 4 + math.radians(parallel) / 2) ** n - rho * F.cos(theta)


def wind_to_north(u: Column, v: Column, lon: Column, parallel: float, lon_0: float) -> tuple[Column, Column]:
    """Eastward and northward wind from a conic grid's own axes, turned by the meridian's convergence."""
    angle = math.sin(math.radians(parallel)) * F.radians(longitude_180(lon - lon_0))
    return u * F.cos(angle) + v * F.sin(angle), v * F.cos(angle) - u * F.sin(angle)


def longitude_180(lon: Column) -> Column:
    """The longitude from -180 up to 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180
