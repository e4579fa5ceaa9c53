"""Orbital elements and satellites over cameras."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from starledger.operators import almanac
from starledger.operators import satellites as op
from starledger.sources import feeds

from .almanac import _AT_SITE, _gmst, _sun
from .registry import query

# The parts stand for a feed: brands are groups, types and sizes titles, and keys the numbers of the lines.
_NUMBERS = {
    "day": "1 + p_partkey % 30 + (p_partkey % 8) / 8.0",
    "inclination": "(p_partkey * 37 % 1000) / 10.0",
    "node": "(p_partkey * 71 % 3600) / 10.0",
    "eccentricity": "(p_partkey * 29 % 200) / 10000.0",
    "perigee": "(p_partkey * 43 % 3600) / 10.0",
    "anomaly": "(p_partkey * 97 % 3600) / 10.0",
    "motion": "11.0 + (p_partkey * 13 % 5000) / 1000.0",
}


def _lines(t):
    """Three lines a record as a feed has them."""
    n = {k: F.expr(v).cast("double") for k, v in _NUMBERS.items()}
    number = F.lpad(F.pmod("p_partkey", F.lit(100000)).cast("string"), 5, "0")
    one = F.concat(F.lit("1 "), number, F.lit("U 24001A   24"), F.format_string("%012.8f", n["day"]), F.lit("  .00000000  00000-0  00000-0 0  9990"))
    eccentricity = F.lpad(F.round(n["eccentricity"] * 1e7).cast("bigint").cast("string"), 7, "0")
    two = F.concat(
        F.lit("2 "), number, F.lit(" "), F.format_string("%8.4f %8.4f ", n["inclination"], n["node"]), eccentricity,
        F.format_string(" %8.4f %8.4f %11.8f", n["perigee"], n["anomaly"], n["motion"]), F.lit("    10"),
    )
    title = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    rows = t.part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.posexplode(F.array(title, one, two)).alias("k", "value"))
    return rows.select("grp", (F.col("id") * 3 + F.col("k")).alias("line"), "value")


def _records(t):
    return feeds.element_records(_lines(t)).withColumnRenamed("record", "id")


_ELEMENTS = "(select p_brand as grp, p_partkey as id, p_type || ' ' || p_size as title, 1704067200.0::double + (day - 1) * 86400.0 as epoch, * from (select *, " + ", ".join(f"({x})::double as {k}" for k, x in _NUMBERS.items()) + " from part))"


_ANGLES = ("inclination", "node", "eccentricity", "perigee", "anomaly", "motion")


@query(f"select grp, id, title, epoch, {', '.join(f'round({c}, 7) as {c}' for c in _ANGLES)} from {_ELEMENTS}")
def orbital_elements(t):
    """The numbers of every record of the feed."""
    return op.elements(_records(t)).select("grp", "id", "title", "epoch", *[F.round(c, 7).alias(c) for c in _ANGLES])


_CATALOGUE = f"(select grp, title, max(id) as id, arg_max(epoch, id) as epoch, arg_max(inclination, id) as inclination, arg_max(node, id) as node, arg_max(eccentricity, id) as eccentricity, arg_max(perigee, id) as perigee, arg_max(anomaly, id) as anomaly, arg_max(motion, id) as motion from {_ELEMENTS} where grp = 'Brand#1' group by grp, title)"
_N = "(motion * (2 * 3.141592653589793 / 86400.0))"
_KEPLER = "(select * replace (u - (u - eccentricity * sin(u) - m) / (1 - eccentricity * cos(u)) as u) from {})"


def _propagated(source):
    rows = f"(select *, {_N} as n, radians(inclination) as i, utc - epoch as dt, pow(398600.8 / ({_N} * {_N}), 1.0 / 3) as a from {source})"
    rows = f"(select *, 1.5 * 1.082616e-3 * pow(6378.135 / (a * (1 - eccentricity * eccentricity)), 2) * n as k from {rows})"
    rows = f"""(select *, radians(node) - k * cos(i) * dt as o, radians(perigee) + k * (2.5 * cos(i) * cos(i) - 0.5) * dt as w,
 radians(anomaly) + (n + k * sqrt(1 - eccentricity * eccentricity) * (1.5 * cos(i) * cos(i) - 0.5)) * dt as m from {rows})"""
    rows = f"(select *, m as u from {rows})"
    for _ in range(6):
        rows = _KEPLER.format(rows)
    rows = f"(select *, a * (cos(u) - eccentricity) as p, a * sqrt(1 - eccentricity * eccentricity) * sin(u) as q from {rows})"
    rows = f"(select *, p * cos(w) - q * sin(w) as g, p * sin(w) + q * cos(w) as h from {rows})"
    return f"(select *, g * cos(o) - h * sin(o) * cos(i) as x, g * sin(o) + h * cos(o) * cos(i) as y, h * sin(i) as z from {rows})"


def _seen(source):
    s = _sun("utc")
    rows = f"(select *, radians(latitude) as la, radians({_gmst('utc')} + longitude) as tu, radians({s['ra']}) as sr, radians({s['dec']}) as sd from {source})"
    squash = "pow(1 - 1 / 298.257, 2)"
    rows = f"(select *, 6378.135 / sqrt(cos(la) * cos(la) + {squash} * sin(la) * sin(la)) as c from {rows})"
    rows = f"(select *, x - c * cos(la) * cos(tu) as dx, y - c * cos(la) * sin(tu) as dy, z - {squash} * c * sin(la) as dz, x * cos(sd) * cos(sr) + y * cos(sd) * sin(sr) + z * sin(sd) as along from {rows})"
    rows = f"(select *, dx * cos(tu) + dy * sin(tu) as ahead, dy * cos(tu) - dx * sin(tu) as east, sqrt(dx * dx + dy * dy + dz * dz) as distance, sqrt(x * x + y * y + z * z) as radius from {rows})"
    return f"""(select *, degrees(asin((ahead * cos(la) + dz * sin(la)) / distance)) as alt, (degrees(atan2(east, dz * cos(la) - ahead * sin(la))) + 360.0) % 360.0 as az,
 not (along < 0 and radius * radius - along * along < 6378.135 * 6378.135) as lit from {rows})"""


@query(f"""with v as (select fid, title, alt, az, distance, z / radius as s from {_seen(_propagated(f"(select * from (select id as fid, latitude, longitude, utc from {_AT_SITE}), {_CATALOGUE} k)"))} where alt >= 20 and lit and radius > 6378.135)
select fid as id, title, round(alt, 5) as alt, round(az, 5) as az, round(distance, 3) as distance, round(degrees(asin(s)), 5) as sublat from v qualify row_number() over (partition by fid order by alt desc, title) <= 10""")
def visible_satellites(t):
    """The ten highest satellites of the visual group that are in the sun over each frame's camera."""
    catalogue = op.latest(op.elements(_records(t)).where("grp = 'Brand#1'")).select("title", "epoch", "inclination", "node", "eccentricity", "perigee", "anomaly", "motion")
    rows = almanac.at_site(t.frames, t.cameras).select("id", "latitude", "longitude", "utc")
    found = op.visible(rows, catalogue)
    top = found.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("alt"), "title"))).where("nth <= 10")
    return top.select("id", "title", F.round("alt", 5).alias("alt"), F.round("az", 5).alias("az"), F.round("distance", 3).alias("distance"), F.round("sublat", 5).alias("sublat"))
