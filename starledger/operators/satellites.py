"""Satellites above a camera: elements, orbits, shadow.

Orbits follow Kepler's equation with the steady drifts that the earth's flattening makes (its
second zonal term); drag and shorter waves are left out, so places hold for some days around the
elements' epoch. Everything is columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions import ephemeris as eph
from starledger.functions.sky import sidereal_degrees

# The earth of the elements' model (km, seconds), the ellipsoid's flattening, its turn in a second.
EARTH_RADIUS, GRAVITY, ZONAL, FLATTENING, TURN = 6378.135, 398600.8, 1.082616e-3, 1 / 298.257, 7.2921159e-5
#: Newton's steps for Kepler's equation; each doubles the digits.
KEPLER_STEPS = 6
#: Seconds of a slot and degrees of a cell in which satellites and sites meet.
SLOT_SECONDS, CELL = 300, 15


def elements(records: DataFrame) -> DataFrame:
    """The numbers of two-line records (title, line1, line2): epoch in UTC seconds, angles in degrees, motion in turns a day.

    Two-digit years before 57 are of this century. A field that is no number is null.
    """
    field = lambda line, start, length: F.substring(line, start, length)
    number = lambda c: F.trim(c).try_cast("double")
    year = F.trim(field("line1", 19, 2)).try_cast("int")
    whole = F.when(year < 57, year + 2000).otherwise(year + 1900)
    first = F.unix_date(F.make_date(whole, F.lit(1), F.lit(1))) * eph.DAY_SECONDS
    return records.select(
        *records.columns,
        (first + (number(field("line1", 21, 12)) - 1) * eph.DAY_SECONDS).alias("epoch"),
        number(field("line2", 9, 8)).alias("inclination"),
        number(field("line2", 18, 8)).alias("node"),
        number(F.concat(F.lit("0."), field("line2", 27, 7))).alias("eccentricity"),
        number(field("line2", 35, 8)).alias("perigee"),
        number(field("line2", 44, 8)).alias("anomaly"),
        number(field("line2", 53, 11)).alias("motion"),
    )


def latest(records: DataFrame, group: str = "grp") -> DataFrame:
    """Of each group and title the record with the highest id."""
    rest = [c for c in records.columns if c not in (group, "title", "id")]
    newest = records.groupBy(group, "title").agg(F.max(F.struct("id", *rest)).alias("r"))
    return newest.select(group, "title", "r.*")


def _then(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with more columns, worked out before what uses them.

    A generator of one row: the optimiser would put each of them into every expression that
    names it, and a filter at the end of a long chain would become one of exponential size.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return rows.select("*", made).select(*kept, *[f"_made.{n}" for n in columns])


def propagated(rows: DataFrame, time: str) -> DataFrame:
    """``rows`` of elements with x, y, z (km, in the frame of the equator) at ``time`` (UTC seconds)."""
    kept = rows.columns
    n = F.col("motion") * (2 * 3.141592653589793 / eph.DAY_SECONDS)
    rows = _then(rows, {"_n": n, "_i": F.radians("inclination"), "_e": F.col("eccentricity"), "_dt": F.col(time) - F.col("epoch")})
    rows = _then(rows, {"_a": F.pow(GRAVITY / (F.col("_n") * F.col("_n")), F.lit(1.0 / 3))})
    rows = _then(rows, {"_k": 1.5 * ZONAL * F.pow(EARTH_RADIUS / (F.col("_a") * (1 - F.col("_e") * F.col("_e"))), F.lit(2.0)) * F.col("_n")})
    c = F.cos("_i")
    drift = {
        "_node": F.radians("node") - F.col("_k") * c * F.col("_dt"),
        "_perigee": F.radians("perigee") + F.col("_k") * (2.5 * c * c - 0.5) * F.col("_dt"),
        "_m": F.radians("anomaly") + (F.col("_n") + F.col("_k") * F.sqrt(1 - F.col("_e") * F.col("_e")) * (1.5 * c * c - 0.5)) * F.col("_dt"),
    }
    rows = _then(_then(rows, drift), {"_u": F.col("_m")})
    u = F.col("_u")
    for _ in range(KEPLER_STEPS):
        rows = _then(rows, {"_u": u - (u - F.col("_e") * F.sin(u) - F.col("_m")) / (1 - F.col("_e") * F.cos(u))})
    rows = _then(rows, {"_p": F.col("_a") * (F.cos(u) - F.col("_e")), "_q": F.col("_a") * F.sqrt(1 - F.col("_e") * F.col("_e")) * F.sin(u)})
    cw, sw, cn, sn, ci, si = F.cos("_perigee"), F.sin("_perigee"), F.cos("_node"), F.sin("_node"), F.cos("_i"), F.sin("_i")
    rows = _then(rows, {"_g": F.col("_p") * cw - F.col("_q") * sw, "_h": F.col("_p") * sw + F.col("_q") * cw})
    place = {"x": F.col("_g") * cn - F.col("_h") * sn * ci, "y": F.col("_g") * sn + F.col("_h") * cn * ci, "z": F.col("_h") * si}
    return _then(rows, place).select(*kept, "x", "y", "z")


def below(rows: DataFrame, time: str) -> DataFrame:
    """``rows`` with sublat, sublon (degrees, of the sphere) and radius (km) of x, y, z."""
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    sublon = F.pmod(F.degrees(F.atan2("y", "x")) - sidereal_degrees(F.col(time)) + 180.0, F.lit(360.0)) - 180.0
    return _then(_then(rows, {"radius": radius}), {"sublat": F.degrees(F.asin(F.col("z") / F.col("radius"))), "sublon": sublon})


def seen(rows: DataFrame, time: str) -> DataFrame:
    """``rows`` with alt, az (degrees) and distance (km) of x, y, z from a site on the ellipsoid (latitude, longitude), and whether the sun shines there."""
    kept = rows.columns
    lat, turn = F.radians("latitude"), F.radians(sidereal_degrees(F.col(time)) + F.col("longitude"))
    sun_ra, sun_dec = (F.radians(eph.sun(F.col(time))[c]) for c in ("ra", "dec"))
    rows = _then(rows, {"_lat": lat, "_turn": turn, "_ra": sun_ra, "_dec": sun_dec})
    squash = (1 - FLATTENING) ** 2
    rows = _then(rows, {"_c": EARTH_RADIUS / F.sqrt(F.cos("_lat") * F.cos("_lat") + squash * F.sin("_lat") * F.sin("_lat"))})
    rows = _then(rows, {"_dx": F.col("x") - F.col("_c") * F.cos("_lat") * F.cos("_turn"), "_dy": F.col("y") - F.col("_c") * F.cos("_lat") * F.sin("_turn"), "_dz": F.col("z") - squash * F.col("_c") * F.sin("_lat")})
    ahead = F.col("_dx") * F.cos("_turn") + F.col("_dy") * F.sin("_turn")
    rows = _then(rows, {"_ahead": ahead, "_east": F.col("_dy") * F.cos("_turn") - F.col("_dx") * F.sin("_turn")})
    rows = _then(rows, {"_up": F.col("_ahead") * F.cos("_lat") + F.col("_dz") * F.sin("_lat"), "_north": F.col("_dz") * F.cos("_lat") - F.col("_ahead") * F.sin("_lat")})
    rows = _then(rows, {"_sx": F.cos("_dec") * F.cos("_ra"), "_sy": F.cos("_dec") * F.sin("_ra"), "_sz": F.sin("_dec")})
    rows = _then(rows, {"_along": F.col("x") * F.col("_sx") + F.col("y") * F.col("_sy") + F.col("z") * F.col("_sz")})
    away = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") - F.col("_along") * F.col("_along")
    distance = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_dz") * F.col("_dz"))
    shadowed = (F.col("_along") < 0) & (away < EARTH_RADIUS * EARTH_RADIUS)
    rows = _then(rows, {"distance": distance})
    view = {"alt": F.degrees(F.asin(F.col("_up") / F.col("distance"))), "az": F.pmod(F.degrees(F.atan2("_east", "_north")), F.lit(360.0)), "lit": ~shadowed}
    return _then(rows, view).select(*kept, "distance", *view)


def _cell(c: Column) -> Column:
    return F.floor(c / CELL).cast("int")


def candidates(rows: DataFrame, catalogue: DataFrame, least_alt: float) -> DataFrame:
    """Rows (utc, latitude, longitude) beside the satellites that may stand ``least_alt`` degrees high there.

    Satellites are placed once a slot of time, not once a row, and spread over the cells of the
    ground from which they may be seen during the slot; rows meet them by slot and cell. Slots
    and satellites meet by block numbers, so the catalogue is never a broadcast.
    """
    blocks = 16
    slotted = rows.withColumn("slot", F.floor(F.col("utc") / SLOT_SECONDS).cast("bigint"))
    slots = slotted.select("slot").distinct().select("slot", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = catalogue.withColumn("block", F.pmod(F.xxhash64("title"), F.lit(blocks)).cast("int"))
    placed = slots.join(dealt, "block").withColumn("middle", F.col("slot") * float(SLOT_SECONDS) + SLOT_SECONDS / 2)
    placed = below(propagated(placed, "middle"), "middle")
    # the ground's angle to the edge of sight, how far the satellite and the ground move within half a slot, and the ellipsoid
    sight = F.degrees(F.acos(F.least(F.lit(1.0), EARTH_RADIUS * F.cos(F.radians(F.lit(float(least_alt)))) / F.col("radius")))) - least_alt
    fastest = F.col("motion") / 240.0 * (SLOT_SECONDS / 2) / F.pow(1 - F.col("eccentricity"), F.lit(2.0))
    placed = _then(placed, {"reach": F.greatest(F.lit(0.0), sight) + fastest + 2.0})
    low, high = F.greatest(F.lit(-90.0), F.col("sublat") - F.col("reach")), F.least(F.lit(90.0), F.col("sublat") + F.col("reach"))
    polar = F.abs("sublat") + F.col("reach") >= 89.0
    width = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("reach")) / F.cos(F.radians("sublat"))))))
    around = 360 // CELL
    first, last = _cell(F.col("sublon") - width), _cell(F.col("sublon") + width)
    lon_cells = F.when(last - first >= around - 1, F.sequence(F.lit(0), F.lit(around - 1))).otherwise(F.array_distinct(F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.lit(around)))))
    reached = placed.select("slot", *catalogue.columns, lon_cells.alias("xs"), F.explode(F.sequence(_cell(low), _cell(high))).alias("cy")).select("slot", *catalogue.columns, "cy", F.explode("xs").alias("cx"))
    sited = slotted.withColumns({"cy": _cell(F.col("latitude")), "cx": F.pmod(_cell(F.col("longitude")), F.lit(around))})
    return sited.join(reached, ["slot", "cy", "cx"]).drop("slot", "cy", "cx")


def visible(rows: DataFrame, catalogue: DataFrame, least_alt: float = 20.0) -> DataFrame:
    """The satellites of ``catalogue`` (title and elements) that stand high enough over each row and in sunlight.

    ``rows``: utc, latitude, longitude and others. Satellites that the orbit has brought to the ground are left out.
    """
    at = propagated(candidates(rows, catalogue, least_alt), "utc")
    return below(seen(at, "utc"), "utc").where((F.col("alt") >= least_alt) & F.col("lit") & (F.col("radius") > EARTH_RADIUS))
