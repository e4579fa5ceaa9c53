"""Places, directions and times of the sky as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METERS = 6_378_100.0
POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW", "N")


def cardinal(degrees: Column) -> Column:
    """the point of the compass; halves go to the even point."""
    return F.element_at(F.array(*[F.lit(p) for p in POINTS]), F.bround(degrees / 22.5).cast("int") + 1)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """metres along the globe."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_METERS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def drop_off(distance: Column) -> Column:
    """how far the ground has sunk below the horizon plane."""
    return EARTH_METERS - EARTH_METERS * F.cos(distance / EARTH_METERS)


def sight(lat: Column, lon: Column, height: Column, lat2: Column, lon2: Column, height2: Column) -> dict[str, Column]:
    """altitude, azimuth (degrees) and range (metres) of a thing seen from a place."""
    flat = haversine(lat, lon, lat2, lon2)
    up = height2 - height - drop_off(flat)
    north, east = haversine(lat, lon, lat2, lon) * F.signum(lat2 - lat), haversine(lat, lon, lat, lon2) * F.signum(lon2 - lon)
    return {"alt": F.degrees(F.atan2(up, flat)), "az": F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0)), "distance": F.hypot(flat, up)}


def sidereal_degrees(epoch_seconds: Column) -> Column:
    """Greenwich mean sidereal time in degrees, the usual polynomial of days and centuries since J2000."""
    days = (epoch_seconds - 946_728_000.0) / 86_400.0
    t = days / 36_525.0
    return F.pmod(280.46061837 + 360.98564736629 * days + 0.000387933 * t * t - t * t * t / 38_710_000.0, F.lit(360.0))


def horizontal(ra: Column, dec: Column, lat: Column, lon: Column, epoch_seconds: Column) -> dict[str, Column]:
    """altitude and azimuth (from north over east) of a star, degrees."""
    hour = F.radians(sidereal_degrees(epoch_seconds) + lon - ra)
    d, p = F.radians(dec), F.radians(lat)
    alt = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p) * F.sin(d) + F.cos(p) * F.cos(d) * F.cos(hour))))
    az = F.atan2(-F.sin(hour) * F.cos(d), F.sin(d) * F.cos(p) - F.cos(d) * F.cos(hour) * F.sin(p))
    return {"alt": F.degrees(alt), "az": F.pmod(F.degrees(az) + 360.0, F.lit(360.0))}


def fisheye(alt: Column, az: Column, diameter: float | Column, x0: float, y0: float, turn: float = 0.0) -> dict[str, Column]:
    """equal-area fisheye: the zenith at the centre, the horizon on the circle, the azimuth ``turn`` up, what lies a quarter on from it left."""
    r = diameter / 2 * math.sqrt(2) * F.sin(F.radians((90.0 - alt) / 2))
    a = F.radians(az - turn)
    return {"x": x0 - r * F.sin(a), "y": y0 - r * F.cos(a)}


def dms(degrees: Column) -> dict[str, Column]:
    """degrees, minutes and seconds with the sign on the degrees."""
    size = F.abs(degrees)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return {"d": (d * F.signum(degrees)).cast("int"), "m": m.cast("int"), "s": (size - d - m / 60) * 3600}


def blend(low: tuple[int, int, int], high: tuple[int, int, int], share: Column) -> list[Column]:
    """a colour between two, whole numbers cut."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    return [(a + (b - a) * s).cast("int") for a, b in zip(low, high, strict=True)]


def light_color(sun_alt: Column, day=(150, 200, 255), dusk=(70, 80, 140), night=(10, 10, 40)) -> list[Column]:
    """day above the horizon, dusk to night down to 18 degrees below it."""
    upper, lower = blend(dusk, day, (sun_alt + 6) / 6), blend(night, dusk, (sun_alt + 18) / 12)
    return [F.when(sun_alt >= 0, d).when(sun_alt >= -6, u).when(sun_alt >= -18, w).otherwise(n) for d, u, w, n in zip(day, upper, lower, night, strict=True)]


def day_date_by_clock(ts: Column) -> Column:
    """F28 without an ephemeris: the date twelve hours before; an approximation."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(12)))
