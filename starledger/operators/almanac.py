"""Days of a site: transits, risings and settings, and what frames take from them.

Roots are found once a camera and day, not once a frame; frames meet their day by an equality
join. Altitudes at a frame's own time are plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions import ephemeris as eph

#: Degrees below the horizon that part day from night; the observatory's own setting.
NIGHT_ALTITUDE = -6.0
#: Halvings of half a day: to a millisecond.
HALVINGS = 26
#: Horizons of the day's events: rise and set, civil, nautical and astronomical twilight.
TWILIGHTS = {"horizon": 0.0, "civil": -6.0, "nautical": -12.0, "astronomical": -18.0}


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp without zone, taken as UTC whatever the session's zone is."""
    return F.unix_date(F.to_date(ts)) * eph.DAY_SECONDS + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def at_site(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """``frames`` with utc (epoch seconds), latitude, longitude and utc_offset of their camera; their own times are local."""
    sites = cameras.select(F.col("id").alias("camera_id"), "latitude", "longitude", "utc_offset")
    return frames.join(sites, "camera_id").withColumn("utc", epoch(F.col("create_date")) - F.col("utc_offset"))


def site_days(frames: DataFrame, cameras: DataFrame, body: str = "sun") -> DataFrame:
    """camera_id, day, latitude, longitude, utc_offset, start and the transits of each local day that has frames.

    ``noon`` is the first upper transit after the day's start (local midnight), ``before`` and
    ``after`` are the lower ones around it.
    """
    days = frames.select("camera_id", F.to_date("create_date").alias("day")).distinct()
    # a few rows with much to work out: spread over the tasks, which a coalesced exchange would not do
    days = days.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "camera_id", "day")
    sites = cameras.select(F.col("id").alias("camera_id"), "latitude", "longitude", "utc_offset")
    start = F.unix_date("day") * eph.DAY_SECONDS - F.col("utc_offset")
    rows = days.join(sites, "camera_id").withColumn("start", start)
    pace, lon = eph.PACES[body], F.col("longitude")
    to_come = F.pmod(-eph.hour_angle(eph.BODIES[body](F.col("start"))["ra"], lon, F.col("start")), F.lit(360.0))
    rows = rows.withColumn("noon", eph.transit(body, F.col("start") + to_come * pace, lon))
    half = 180.0 * pace
    return rows.withColumn("before", eph.transit(body, F.col("noon") - half, lon, lower=True)).withColumn("after", eph.transit(body, F.col("noon") + half, lon, lower=True))


def events(days: DataFrame, body: str, horizons: dict[str, float], steps: int = HALVINGS) -> DataFrame:
    """camera_id, day, event, rises, moment: when the body crosses each horizon around the day's noon; null where it does not."""
    spans = []
    for name, h in horizons.items():
        for rises, since, until in ((True, "before", "noon"), (False, "noon", "after")):
            spans.append(F.struct(F.lit(name).alias("event"), F.lit(rises).alias("rises"), F.col(since).alias("since"), F.col(until).alias("until"), F.lit(float(h)).alias("horizon")))
    long = days.select("camera_id", "day", "latitude", "longitude", F.explode(F.array(*spans)).alias("e")).select("camera_id", "day", "latitude", "longitude", "e.*")
    at = eph.crossing(body, F.col("since"), F.col("until"), F.col("latitude"), F.col("longitude"), F.col("horizon"), F.col("rises"), steps)
    return long.select("camera_id", "day", "event", "rises", at.alias("moment"))


def day_of(utc: Column, local_day: Column, night: Column, before: Column, noon: Column, after: Column) -> Column:
    """the date of a frame's day by the sun's transits; a night keeps the date of its evening."""
    yesterday, tomorrow = F.date_sub(local_day, 1), F.date_add(local_day, 1)
    return F.when(utc < before, yesterday).when(utc < noon, F.when(night, yesterday).otherwise(local_day)).when(utc < after, local_day).otherwise(F.when(night, local_day).otherwise(tomorrow))


def with_day(frames: DataFrame, cameras: DataFrame, night_altitude: float = NIGHT_ALTITUDE) -> DataFrame:
    """``frames`` at their site with sun_alt, dark, day and the transits of their local day."""
    there = at_site(frames, cameras).withColumn("day", F.to_date("create_date"))
    there = there.withColumn("sun_alt", eph.altitude(eph.sun(F.col("utc")), F.col("latitude"), F.col("longitude"), F.col("utc"))).withColumn("dark", F.col("sun_alt") < night_altitude)
    days = site_days(frames, cameras).select("camera_id", "day", "before", "noon", "after")
    return there.join(days, ["camera_id", "day"])


def next_stop(rows: DataFrame) -> DataFrame:
    """When the running night or day ends, by the sun's transits: nights at noon, days at midnight.

    ``rows`` come from ``with_day``. The transits of the day after are needed too, a solar day on.
    """
    lon = F.col("longitude")
    rows = rows.withColumn("noon_2", eph.transit("sun", F.col("noon") + eph.DAY_SECONDS, lon)).withColumn("after_2", eph.transit("sun", F.col("after") + eph.DAY_SECONDS, lon, lower=True))
    utc, dark = F.col("utc"), F.col("dark")
    night_stop = F.when(utc < F.col("before"), F.col("noon")).when(utc < F.col("noon"), F.when(dark, F.col("noon")).otherwise(F.col("noon_2"))).otherwise(F.col("noon_2"))
    day_stop = (
        F.when(utc < F.col("before"), F.when(dark, F.col("after")).otherwise(F.col("before")))
        .when(utc < F.col("noon"), F.col("after"))
        .when(utc < F.col("after"), F.when(dark, F.col("after_2")).otherwise(F.col("after")))
        .otherwise(F.col("after_2"))
    )
    return rows.withColumn("stop", F.least(night_stop, day_stop))


def mode_changes(frames: DataFrame, cameras: DataFrame, night_altitude: float = NIGHT_ALTITUDE) -> DataFrame:
    """``with_day`` and when the sun next crosses the night's altitude: up out of a night, down out of a day.

    The upper edge of the sun counts. Null where it does not within the three days around.
    """
    horizon = night_altitude - eph.SUN_RADIUS
    first = site_days(frames, cameras)
    lon = F.col("longitude")
    shifted = first.select("camera_id", "day", "latitude", "longitude", "noon", F.explode(F.array(*map(F.lit, range(-1, 3)))).alias("k"))
    noon = eph.transit("sun", F.col("noon") + F.col("k") * eph.DAY_SECONDS, lon)
    turns = shifted.withColumn("noon", noon).withColumn("before", eph.transit("sun", F.col("noon") - eph.DAY_SECONDS / 2, lon, lower=True)).withColumn("after", eph.transit("sun", F.col("noon") + eph.DAY_SECONDS / 2, lon, lower=True))
    found = events(turns, "sun", {"night": horizon})
    # eight times a camera and day
    lists = found.groupBy("camera_id", "day").agg(F.collect_list(F.when(F.col("rises"), F.col("moment"))).alias("ups"), F.collect_list(F.when(~F.col("rises"), F.col("moment"))).alias("downs"))
    rows = with_day(frames, cameras, night_altitude).join(lists, ["camera_id", "day"])
    due = F.when(F.col("dark"), F.col("ups")).otherwise(F.col("downs"))
    return rows.withColumn("change", F.array_min(F.filter(due, lambda x: x > F.col("utc"))))


def moon_state(frames: DataFrame, cameras: DataFrame, night_altitude: float = NIGHT_ALTITUDE, moon_altitude: float = 0.0, moon_lit: float = 0.33) -> DataFrame:
    """``at_site`` with moon_alt, passed (share of the lunation), lit, waxing, and moonlit: dark with the moon up and bright enough."""
    there = at_site(frames, cameras)
    utc, lat, lon = F.col("utc"), F.col("latitude"), F.col("longitude")
    there = there.withColumns({"sun_alt": eph.altitude(eph.sun(utc), lat, lon, utc), "moon_alt": eph.altitude(eph.moon(utc), lat, lon, utc), "passed": eph.lunation(utc)})
    there = there.withColumn("lit", eph.lit_share(F.col("passed"))).withColumn("waxing", F.col("passed") < 0.5)
    return there.withColumn("moonlit", (F.col("sun_alt") < night_altitude) & (F.col("moon_alt") >= moon_altitude) & (F.col("lit") >= moon_lit))


def conjunctions(frames: DataFrame, within: float = 1.5) -> DataFrame:
    """The least and greatest distance of sun and moon over each UTC hour that has frames, and whether an eclipse may be: near, or near opposite."""
    hours = frames.select(F.floor(F.col("utc") / 3600).cast("bigint").alias("hour")).distinct()
    minutes = hours.select("hour", F.explode(F.sequence(F.lit(0), F.lit(55), F.lit(5))).alias("m"))
    at = F.col("hour") * 3600.0 + F.col("m") * 60.0
    apart = minutes.select("hour", eph.separation(eph.sun(at), eph.moon(at)).alias("apart")).groupBy("hour").agg(F.min("apart").alias("nearest"), F.max("apart").alias("farthest"))
    return apart.withColumn("solar", F.col("nearest") < within).withColumn("lunar", F.col("farthest") > 180.0 - within)
