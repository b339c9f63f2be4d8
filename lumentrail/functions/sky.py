"""Scalar expressions: positions, times, sky geometry, magnitudes."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def position(x0: Column, v: Column, t: Column) -> Column:
    """Pixel index at a time: positions are centred, so half a pixel is added before the floor."""
    return F.floor(x0 + v * t + 0.5).cast("int")


def predicted(x0: Column, v: Column, t: Column, centered: bool = True) -> Column:
    return x0 + v * t + (0.5 if centered else 0.0)


def truncated(x0: Column, v: Column, t: Column) -> Column:
    """Pixel index by truncation toward zero; differs from ``position`` for negative positions."""
    return (x0 + v * t + 0.5).cast("int")


def is_valid(v: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def mjd(ts: Column) -> Column:
    """Modified Julian date of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(86_400_000_000.0) + F.lit(40587.0)


def day_of(mjd_col: Column) -> Column:
    """Calendar day (UTC) of a modified Julian date."""
    return F.date_from_unix_date((F.floor(mjd_col) - 40587).cast("int"))


def observing_day(mjd_col: Column) -> Column:
    """The night of an observation as YYYYMMDD: days begin at noon."""
    return F.date_format(day_of(mjd_col - 0.5), "yyyyMMdd")


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees, by the haversine formula."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def tan_to_pixel(ra: Column, dec: Column, ra0: float, dec0: float, scale: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Pixel position in a tangent-plane image centred on (ra0, dec0) with ``scale`` degrees per pixel."""
    r, d, d0 = F.radians(ra - ra0), F.radians(dec), math.radians(dec0)
    down = F.sin(d) * math.sin(d0) + F.cos(d) * math.cos(d0) * F.cos(r)
    xi = F.degrees(F.cos(d) * F.sin(r) / down)
    eta = F.degrees((F.sin(d) * math.cos(d0) - F.cos(d) * math.sin(d0) * F.cos(r)) / down)
    return xi / scale + x0, eta / scale + y0


def tan_to_sky(x: Column, y: Column, ra0: float, dec0: float, scale: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Right ascension and declination in degrees of a pixel; the inverse of ``tan_to_pixel``."""
    xi, eta, d0 = F.radians((x - x0) * scale), F.radians((y - y0) * scale), math.radians(dec0)
    down = math.cos(d0) - eta * math.sin(d0)
    ra = F.degrees(F.atan2(xi, down)) + ra0
    dec = F.degrees(F.atan2(math.sin(d0) + eta * math.cos(d0), F.sqrt(xi * xi + down * down)))
    return F.pmod(ra, F.lit(360.0)), dec


def magnitude(flux: Column, zero_point: Column) -> Column:
    """-2.5 log10(flux) + zero point; null for a flux that isn't positive."""
    return F.when(flux > 0, -2.5 * F.log10(flux) + zero_point)


def flux_scale(mag: Column) -> Column:
    """Divisor of the flux for a difference in magnitude."""
    return F.pow(F.lit(10.0), mag / 2.5)


def parallax_corrected(ra: Column, dec: Column, earth: tuple[Column, Column, Column], distance: Column, largest: bool = False) -> tuple[Column, Column, Column]:
    """Where an object at ``distance`` from the barycentre lies as seen from there: ra, dec, distance from Earth.

    ``earth``: the observer's barycentric position in the unit of ``distance``. The line of sight meets the
    sphere of that radius at the smaller positive root (with ``largest`` the larger); null if it misses.
    """
    u = (F.cos(F.radians(dec)) * F.cos(F.radians(ra)), F.cos(F.radians(dec)) * F.sin(F.radians(ra)), F.sin(F.radians(dec)))
    b = sum((e * c for e, c in zip(earth, u, strict=True)), F.lit(0.0))
    c = sum((e * e for e in earth), F.lit(0.0)) - distance * distance
    root = F.when(b * b - c >= 0, F.sqrt(b * b - c))
    near, far = -b - root, -b + root
    s = F.when(F.lit(largest) | (near <= 0), F.when(far > 0, far)).otherwise(near)
    p = [e + s * c for e, c in zip(earth, u, strict=True)]
    return F.pmod(F.degrees(F.atan2(p[1], p[0])), F.lit(360.0)), F.degrees(F.asin(p[2] / distance)), s


def parallax_inverted(ra: Column, dec: Column, earth: tuple[Column, Column, Column], distance: Column) -> tuple[Column, Column]:
    """Where an object at a barycentric direction and distance is seen from Earth."""
    p = (distance * F.cos(F.radians(dec)) * F.cos(F.radians(ra)), distance * F.cos(F.radians(dec)) * F.sin(F.radians(ra)), distance * F.sin(F.radians(dec)))
    d = [a - e for a, e in zip(p, earth, strict=True)]
    return F.pmod(F.degrees(F.atan2(d[1], d[0])), F.lit(360.0)), F.degrees(F.atan2(d[2], F.sqrt(d[0] * d[0] + d[1] * d[1])))


def ecliptic_angle(ra: float, dec: float) -> float:
    """Angle of the ecliptic to the direction of increasing right ascension at a place in the sky, in radians."""
    eps, a, d = math.radians(23.4392911), math.radians(ra), math.radians(dec)

    def to_ecliptic(a: float, d: float) -> tuple[float, float]:
        return math.atan2(math.sin(a) * math.cos(eps) + math.tan(d) * math.sin(eps), math.cos(a)), math.asin(math.sin(d) * math.cos(eps) - math.cos(d) * math.sin(eps) * math.sin(a))

    def to_equatorial(lon: float, lat: float) -> tuple[float, float]:
        return math.atan2(math.sin(lon) * math.cos(eps) - math.tan(lat) * math.sin(eps), math.cos(lon)), math.asin(math.sin(lat) * math.cos(eps) + math.cos(lat) * math.sin(eps) * math.sin(lon))

    lon, lat = to_ecliptic(a, d)
    a2, d2 = to_equatorial(lon + 1e-5, lat)
    step = (a2 - a + math.pi) % (2 * math.pi) - math.pi
    return math.atan2(d2 - d, step * math.cos(d))


def clip_coefficient(low: float = 25, high: float = 75) -> float:
    """Sigma of a normal distribution per distance of two of its percentiles; 0.7413 for the quartiles."""
    inv = NormalDist().inv_cdf
    return 1 / (inv(high / 100) - inv(low / 100))
