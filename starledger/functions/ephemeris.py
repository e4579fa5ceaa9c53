"""Sun and moon as Column expressions of UTC epoch seconds.

Truncated series: the sun to about 0.01 degree between 1950 and 2050, the moon to about 0.05.
Refraction is left out throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sky import sidereal_degrees

J2000_SECONDS, DAY_SECONDS, CENTURY_DAYS = 946_728_000.0, 86_400.0, 36_525.0
EARTH_KM, SUN_RADIUS, MOON_RADIUS = 6378.14, 0.2666, 0.2591
#: Seconds in which the hour angle of each body grows by a degree, about.
SUN_PACE, MOON_PACE = 240.0, 248.41

# Published series, degrees (kilometres for the distance). A term is its size and
# the multiples of elongation, sun's anomaly, moon's anomaly and argument of latitude.
MOON_LONGITUDE = (
    (6.288774, (0, 0, 1, 0)), (1.274027, (2, 0, -1, 0)), (0.658314, (2, 0, 0, 0)), (0.213618, (0, 0, 2, 0)), (-0.185116, (0, 1, 0, 0)),
    (-0.114332, (0, 0, 0, 2)), (0.058793, (2, 0, -2, 0)), (0.057066, (2, -1, -1, 0)), (0.053322, (2, 0, 1, 0)), (0.045758, (2, -1, 0, 0)),
    (-0.040923, (0, 1, -1, 0)), (-0.034720, (1, 0, 0, 0)), (-0.030383, (0, 1, 1, 0)), (0.015327, (2, 0, 0, -2)),
)
MOON_LATITUDE = (
    (5.128122, (0, 0, 0, 1)), (0.280602, (0, 0, 1, 1)), (0.277693, (0, 0, 1, -1)), (0.173237, (2, 0, 0, -1)),
    (0.055413, (2, 0, -1, 1)), (0.046271, (2, 0, -1, -1)), (0.032573, (2, 0, 0, 1)), (0.017198, (0, 0, 2, 1)),
)
MOON_DISTANCE = ((-20905.355, (0, 0, 1, 0)), (-3699.111, (2, 0, -1, 0)), (-2955.968, (2, 0, 0, 0)), (-569.925, (0, 0, 2, 0)))
#: Value at J2000 and growth in a century: mean longitude, elongation, sun's and moon's anomaly, argument of latitude.
MOON_ANGLES = ((218.3164477, 481267.88123421), (297.8501921, 445267.1114034), (357.5291092, 35999.0502909), (134.9633964, 477198.8675055), (93.2720950, 483202.0175233))

Place = dict[str, Column]


def _days(epoch: Column) -> Column:
    return (epoch - J2000_SECONDS) / DAY_SECONDS


def _equatorial(lon: Column, lat: Column | None, days: Column) -> tuple[Column, Column]:
    """Right ascension and declination, degrees."""
    tilt, a = F.radians(23.439 - 0.0000004 * days), F.radians(lon)
    if lat is None:
        return F.degrees(F.atan2(F.cos(tilt) * F.sin(a), F.cos(a))), F.degrees(F.asin(F.sin(tilt) * F.sin(a)))
    b = F.radians(lat)
    ra = F.atan2(F.sin(a) * F.cos(tilt) - F.tan(b) * F.sin(tilt), F.cos(a))
    return F.degrees(ra), F.degrees(F.asin(F.sin(b) * F.cos(tilt) + F.cos(b) * F.sin(tilt) * F.sin(a)))


def sun_longitude(epoch: Column) -> Column:
    """Ecliptic longitude, degrees, not brought into a turn."""
    n = _days(epoch)
    g = F.radians(357.528 + 0.9856003 * n)
    return 280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g)


def sun(epoch: Column) -> Place:
    """lon, ra, dec in degrees."""
    lon = sun_longitude(epoch)
    ra, dec = _equatorial(lon, None, _days(epoch))
    return {"lon": lon, "ra": ra, "dec": dec}


def _series(terms: tuple, angles: list[Column], wave: Callable[[Column], Column]) -> Column:
    total = None
    for size, multiples in terms:
        angle = None
        for k, a in zip(multiples, angles, strict=True):
            if k:
                part = k * a
                angle = part if angle is None else angle + part
        part = size * wave(F.radians(angle))
        total = part if total is None else total + part
    return total


def moon(epoch: Column) -> Place:
    """lon, lat, ra, dec in degrees, and distance in kilometres, from the centre of the earth."""
    t = _days(epoch) / CENTURY_DAYS
    mean, *angles = [start + growth * t for start, growth in MOON_ANGLES]
    lon, lat = mean + _series(MOON_LONGITUDE, angles, F.sin), _series(MOON_LATITUDE, angles, F.sin)
    ra, dec = _equatorial(lon, lat, _days(epoch))
    return {"lon": lon, "lat": lat, "ra": ra, "dec": dec, "distance": 385000.56 + _series(MOON_DISTANCE, angles, F.cos)}


def hour_angle(ra: Column, lon: Column, epoch: Column) -> Column:
    """Degrees since the body stood in the south, from -180 to 180."""
    return F.pmod(sidereal_degrees(epoch) + lon - ra + 180.0, F.lit(360.0)) - 180.0


def altitude(place: Place, lat: Column, lon: Column, epoch: Column) -> Column:
    """Degrees above the horizon; with a distance, as seen from the surface instead of the centre."""
    p, d, h = F.radians(lat), F.radians(place["dec"]), F.radians(sidereal_degrees(epoch) + lon - place["ra"])
    up = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p) * F.sin(d) + F.cos(p) * F.cos(d) * F.cos(h))))
    if "distance" in place:
        up = up - F.asin(EARTH_KM / place["distance"]) * F.cos(up)
    return F.degrees(up)


def separation(a: Place, b: Place) -> Column:
    """Degrees between two places of the sky."""
    x, y = F.radians(a["dec"]), F.radians(b["dec"])
    cosine = F.sin(x) * F.sin(y) + F.cos(x) * F.cos(y) * F.cos(F.radians(a["ra"] - b["ra"]))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def lunation(epoch: Column) -> Column:
    """how much of the lunation has passed, from 0 to 1; new at 0, full at a half."""
    return F.pmod(moon(epoch)["lon"] - sun_longitude(epoch), F.lit(360.0)) / 360.0


def lit_share(passed: Column) -> Column:
    """Share of the moon's disc that is lit, from how much of the lunation has passed."""
    return (1 - F.cos(F.radians(passed * 360.0))) / 2


BODIES: dict[str, Callable[[Column], Place]] = {"sun": sun, "moon": moon}
PACES = {"sun": SUN_PACE, "moon": MOON_PACE}


def transit(body: str, near: Column, lon: Column, lower: bool = False, steps: int = 5) -> Column:
    """When a body crosses the meridian (``lower``: under the pole) nearest to ``near``; each step is 300 times closer, 25 times for the moon."""
    off = 180.0 if lower else 0.0
    late = lambda t: F.pmod(hour_angle(BODIES[body](t)["ra"], lon, t) - off + 180.0, F.lit(360.0)) - 180.0
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), near, lambda t, _: t - late(t) * PACES[body])


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once: within lambdas nothing else shares an expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _altitude_once(body: str, lat: Column, lon: Column, t: Column) -> Column:
    """``altitude`` of a body for use in lambdas."""
    p, days = F.radians(lat), _days(t)

    def up(ra: Column, dec: Column) -> Column:
        sine = lambda d: F.sin(p) * F.sin(d) + F.cos(p) * F.cos(d) * F.cos(F.radians(sidereal_degrees(t) + lon - ra))
        return _bound(F.radians(dec), lambda d: F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sine(d))))))

    if body == "sun":
        return _bound(sun_longitude(t), lambda x: up(*_equatorial(x, None, days)))
    at = moon(t)
    seen = _bound(at["lon"], lambda x: _bound(at["lat"], lambda y: up(*_equatorial(x, y, days))))
    return _bound(F.radians(seen), lambda h: F.degrees(h - F.asin(EARTH_KM / at["distance"]) * F.cos(h)))


def crossing(body: str, since: Column, until: Column, lat: Column, lon: Column, horizon: Column, rises: Column, steps: int = 40) -> Column:
    """When a body rises above, or sinks below, ``horizon`` between its transits ``since`` and ``until``.

    By halving, ``steps`` times; null where it does neither, as in a polar night.
    """
    before = lambda t: (_altitude_once(body, lat, lon, t) >= horizon) != rises
    later = lambda t, x: F.when(before(x), x).otherwise(t)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), since, lambda t, k: _bound(t + (until - since) / F.pow(F.lit(2.0), k), lambda x: later(t, x)))
    return F.when(before(since) & ~before(until), found)
