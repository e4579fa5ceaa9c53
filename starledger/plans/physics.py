"""Sensor arithmetic and sky geometry."""

from pyspark.sql import functions as F

from starledger.functions import sensors, sky

from .registry import query


def _r(digits=6, **columns):
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


_SQL_CONVERSIONS = {
    "c_to_f": "v * 9.0 / 5.0 + 32", "f_to_c": "(v - 32) * 5.0 / 9.0", "c_to_k": "v + 273.15", "k_to_c": "v - 273.15", "f_to_k": "(v - 32) * 5.0 / 9.0 + 273.15", "k_to_f": "(v - 273.15) * 9.0 / 5.0 + 32",
    "hpa_to_psi": "v * 0.0145037738", "hpa_to_inhg": "v / 33.86389", "inhg_to_hpa": "v * 33.86389", "hpa_to_mmhg": "v / 1.333224", "mmhg_to_hpa": "v * 1.333224",
    "mps_to_mph": "v * 2.2369362920544", "mps_to_knots": "v * 1.9438444924406", "mps_to_kph": "v * 3.6", "kph_to_mph": "v / 1.609344", "mph_to_kph": "v * 1.609344", "m_to_ft": "v * 3.280839895", "mm_to_in": "v / 25.4",
    "inhg_to_psi": "v * 33.86389 * 0.0145037738", "inhg_to_mmhg": "v * 25.4", "km_to_mi": "v / 1.609344", "kph_to_knots": "v / 1.852", "mph_to_knots": "v * 1.609344 / 1.852", "mph_to_mps": "v * 1.609344 / 3.6",
}


@query("select id, " + ", ".join(f"round({x}, 8) as {n}" for n, x in _SQL_CONVERSIONS.items()) + " from (select id, adu as v from frames)")
def unit_conversions(t):
    """inches of mercury become hectopascals by the physical factor."""
    return t.frames.select("id", *_r(8, **{n: f(F.col("adu")) for n, f in sensors.CONVERSIONS.items()}))


@query("""with s as (select id, sqm as c, least(100.0::double, stars::double) as h from frames),
d as (select *, case when h > 0 then 237.7 * (17.27 * c / (237.7 + c) + ln(h / 100)) / (17.27 - (17.27 * c / (237.7 + c) + ln(h / 100))) end as dew from (select id, c, case when h > 0 then h end as h from s))
select id, round(dew, 6) as dew, round(dew + 273.15 + 2671.02 / (2954.61 / (c + 273.15) + 2.193665 * ln(c + 273.15) - 13.3448) - (c + 273.15) - 273.15, 6) as frost,
round(-42.379 + 2.04901523 * f + 10.14333127 * h - 0.22475541 * f * h - 0.00683783 * f * f - 0.05481717 * h * h + 0.00122874 * f * f * h + 0.00085282 * f * h * h - 0.00000199 * f * f * h * h, 6) as heat from (select *, c * 9.0 / 5.0 + 32 as f from d)""")
def dew_frost_heat(t):
    """Without humidity there is no dew point."""
    c, h = F.col("sqm"), F.when(F.col("stars") > 0, F.least(F.lit(100.0), F.col("stars").cast("double")))
    dew = sensors.dew_point(c, h)
    return t.frames.select("id", *_r(dew=dew, frost=sensors.frost_point(c, dew), heat=sensors.heat_index(c * 9.0 / 5.0 + 32, h)))


@query("""select id, round(case when adu - 100 > 0 then -2.5 * log10(greatest(adu - 100, 1e-9)) else 0 end, 8) as mag, round(((60.0 - exposure) / 10 + 1) * (adu * ((1000.0 - gain) / 10 + 1)), 8) as weighted,
round(least(60.0, greatest(0.00001, case when adu > 0 then exposure - (exposure - exposure * (75.0 / adu)) * 0.5 else exposure end)), 8) as next_exposure, round(case when gain > 0 then 20 * log10(greatest(gain, 1) / 100.0) end, 8) as decibel,
cast(floor(floor(adu * 100) / 256.0) as int) as bits8, case when delta <= 1 then 'high' when delta <= 3 then 'medium' when delta <= 6 then 'low' else 'off' end as heater from (select *, sqm - 15 as delta from frames)""")
def exposure_and_brightness(t):
    """F15, F16, F22, F23, F27, F29."""
    c = F.col
    return t.frames.select(
        "id", *_r(8, mag=sensors.magnitude(c("adu") - 100), weighted=sensors.weighted_sqm(c("adu"), c("exposure"), c("gain"), 60.0, 1000.0), next_exposure=sensors.next_exposure(c("exposure"), c("adu"), 75.0, 0.5, 0.00001, 60.0), decibel=sensors.to_decibel(c("gain"), 100.0)),
        sensors.eight_bits(F.floor(c("adu") * 100), 16).alias("bits8"), sensors.tier(c("sqm") - 15, 6.0, 3.0, 1.0).alias("heater"),
    )


@query("select c.id, i::int as step, round(i * 37.5::double + 100.0, 3) as gain from cameras c, range(9) t(i)")
def gain_ladder(t):
    """F24."""
    return t.cameras.select("id", F.posexplode(sensors.gain_ladder(100.0, 400.0, 8)).alias("step", "gain"))


_HAV = "2 * 6378100.0 * asin(least(1.0, sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))))"


@query(f"""with p as (select id, latitude as a, longitude as b, latitude + 0.3 as c, longitude - 0.4 as d, 9000.0::double as h from cameras),
q as (select *, {_HAV.format('a', 'b', 'c', 'd')} as flat, {_HAV.format('a', 'b', 'c', 'b')} * sign(c - a) as north, {_HAV.format('a', 'b', 'a', 'd')} * sign(d - b) as east from p),
u as (select *, h - (6378100.0 - 6378100.0 * cos(flat / 6378100.0)) as up from q)
select id, round(flat, 3) as flat, round(degrees(atan2(up, flat)), 6) as alt, round((degrees(atan2(east, north)) + 360.0) % 360.0, 6) as az, round(sqrt(flat * flat + up * up), 3) as distance from u""")
def aircraft_sight(t):
    """An aircraft to the north-west of each camera."""
    a, b = F.col("latitude"), F.col("longitude")
    s = sky.sight(a, b, F.lit(0.0), a + 0.3, b - 0.4, F.lit(9000.0))
    return t.cameras.select("id", F.round(sky.haversine(a, b, a + 0.3, b - 0.4), 3).alias("flat"), F.round(s["alt"], 6).alias("alt"), F.round(s["az"], 6).alias("az"), F.round(s["distance"], 3).alias("distance"))


_PROJECTED = """with s as (select n_nationkey as star, (n_nationkey * 14.4)::double as ra, (n_nationkey * 6.0 - 70)::double as dec from nation), c as (select id, latitude as lat, longitude as lon from cameras),
d as (select *, (1770000000.0::double - 946728000.0) / 86400.0 as days from s, c),
g as (select *, (((280.46061837 + 360.98564736629 * days + 0.000387933 * (days / 36525.0) * (days / 36525.0) - (days / 36525.0) * (days / 36525.0) * (days / 36525.0) / 38710000.0) % 360.0) + 360.0) % 360.0 as gmst from d),
h as (select *, radians(gmst + lon - ra) as ha from g),
a as (select *, degrees(asin(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(dec)) + cos(radians(lat)) * cos(radians(dec)) * cos(ha))))) as alt,
 (degrees(atan2(-sin(ha) * cos(radians(dec)), sin(radians(dec)) * cos(radians(lat)) - cos(radians(dec)) * cos(ha) * sin(radians(lat)))) + 360.0) % 360.0 as az from h)
select id, star, round(alt, 6) as alt, round(az, 6) as az, round(960 - 850.0 * sqrt(2.0) * sin(radians((90.0 - alt) / 2)) * sin(radians(az - 37.5)), 6) as x, round(960 - 850.0 * sqrt(2.0) * sin(radians((90.0 - alt) / 2)) * cos(radians(az - 37.5)), 6) as y from a where alt > 0"""


@query(_PROJECTED)
def star_projection(t):
    """each camera's sky holds the whole catalogue."""
    return _projected(_stars(t), t.cameras)


query(_PROJECTED, name="star_projection_all")(star_projection)


#: Blocks that the catalogue is dealt into; each camera meets every block by its number.
CATALOGUE_BLOCKS = 16


def _stars(t):
    return t.nation.select(F.col("n_nationkey").alias("star"), (F.col("n_nationkey") * 14.4).alias("ra"), (F.col("n_nationkey") * 6.0 - 70).alias("dec"))


def _projected(stars, cameras):
    dealt = stars.withColumn("block", F.pmod(F.col("star"), F.lit(CATALOGUE_BLOCKS)).cast("int"))
    seen = cameras.select("id", "latitude", "longitude", F.explode(F.sequence(F.lit(0), F.lit(CATALOGUE_BLOCKS - 1))).alias("block")).join(dealt, "block")
    at = sky.horizontal(F.col("ra"), F.col("dec"), F.col("latitude"), F.col("longitude"), F.lit(1_770_000_000.0))
    up = seen.withColumns(at).where("alt > 0")
    xy = sky.fisheye(F.col("alt"), F.col("az"), 1700.0, 960.0, 960.0, 37.5)
    return up.select("id", "star", *_r(alt=F.col("alt"), az=F.col("az"), **xy))


@query("select id, cast(floor(abs(latitude)) * sign(latitude) as int) as d, cast(floor((abs(latitude) - floor(abs(latitude))) * 60) as int) as m, round((abs(latitude) - floor(abs(latitude)) - floor((abs(latitude) - floor(abs(latitude))) * 60) / 60) * 3600, 6) as s from cameras")
def degrees_minutes_seconds(t):
    """F21."""
    p = sky.dms(F.col("latitude"))
    return t.cameras.select("id", p["d"].alias("d"), p["m"].alias("m"), F.round(p["s"], 6).alias("s"))
