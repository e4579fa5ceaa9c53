"""Sun, moon and days of a site against published almanac values and plain loops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starledger.functions import ephemeris as eph
from starledger.operators import almanac


def seconds(*at):
    return dt.datetime(*at, tzinfo=dt.UTC).timestamp()


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_places_of_sun_and_moon(spark):
    """Textbook examples: the sun of 1992 October 13, the moon of 1992 April 12, both at 0 hours."""
    sun, moon = eph.sun(F.lit(seconds(1992, 10, 13))), eph.moon(F.lit(seconds(1992, 4, 12)))
    r = one(spark, ra=F.pmod(sun["ra"], F.lit(360.0)), dec=sun["dec"], lon=F.pmod(moon["lon"], F.lit(360.0)), lat=moon["lat"], far=moon["distance"])
    assert abs(r.ra - 198.38083) < 0.02 and abs(r.dec + 7.78507) < 0.01
    assert abs(r.lon - 133.1627) < 0.06 and abs(r.lat + 3.2291) < 0.05 and abs(r.far - 368409.7) < 800


@pytest.mark.parametrize("at, share", [((2024, 1, 11, 11, 57), 0.0), ((2024, 1, 25, 17, 54), 0.5), ((2024, 1, 18, 3, 53), 0.25)])
def test_phases(spark, at, share):
    passed = one(spark, p=eph.lunation(F.lit(seconds(*at)))).p
    assert min(abs(passed - share), abs(passed - share - 1)) < 0.0005


def test_eclipse_of_april_2024(spark):
    at = F.lit(seconds(2024, 4, 8, 18, 18))
    assert one(spark, s=eph.separation(eph.sun(at), eph.moon(at))).s < 0.5
    frames = spark.createDataFrame([(seconds(2024, 4, 8, 18, 1),), (seconds(2024, 4, 9, 18, 1),), (seconds(2024, 3, 25, 7, 10),)], "utc double")
    got = {r.hour: (r.solar, r.lunar) for r in almanac.conjunctions(frames).collect()}
    assert list(dict(sorted(got.items())).values()) == [(False, True), (True, False), (False, False)]


def site(spark, lat, lon, *times):
    cameras = spark.createDataFrame([(1, lat, lon, 0)], "id int, latitude double, longitude double, utc_offset int")
    frames = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "id int, camera_id int, create_date timestamp_ntz")
    return frames, cameras


def test_transits_and_sunrise(spark):
    """The equation of time at its extremes, and midsummer in Greenwich with the usual 50 minutes of arc below the horizon."""
    frames, cameras = site(spark, 51.4769, 0.0, dt.datetime(2024, 11, 3, 5), dt.datetime(2024, 2, 11, 5), dt.datetime(2024, 6, 21, 5))
    days = almanac.site_days(frames, cameras)
    noon = {r.day: dt.datetime.fromtimestamp(r.noon, dt.UTC) for r in days.collect()}
    assert abs((noon[dt.date(2024, 11, 3)] - dt.datetime(2024, 11, 3, 11, 43, 35, tzinfo=dt.UTC)).total_seconds()) < 12
    assert abs((noon[dt.date(2024, 2, 11)] - dt.datetime(2024, 2, 11, 12, 14, 13, tzinfo=dt.UTC)).total_seconds()) < 12
    found = {(r.day, r.rises): r.moment for r in almanac.events(days, "sun", {"visible": -0.833}).collect()}
    june = dt.date(2024, 6, 21)
    assert abs(found[june, True] - seconds(2024, 6, 21, 3, 43)) < 60 and abs(found[june, False] - seconds(2024, 6, 21, 20, 21, 30)) < 60


def test_moonrise_is_at_the_horizon(spark):
    frames, cameras = site(spark, 40.0, -75.0, *[dt.datetime(2024, 1, d, 5) for d in range(1, 29)])
    days = almanac.site_days(frames, cameras, "moon")
    rows = almanac.events(days, "moon", {"horizon": 0.0}).select("rises", "moment", eph.altitude(eph.moon(F.col("moment")), F.lit(40.0), F.lit(-75.0), F.col("moment")).alias("alt")).collect()
    assert len(rows) == 56 and all(abs(r.alt) < 1e-3 for r in rows)


def test_polar_night(spark):
    frames, cameras = site(spark, 80.0, 0.0, dt.datetime(2024, 12, 21, 5), dt.datetime(2024, 6, 21, 5))
    found = almanac.events(almanac.site_days(frames, cameras), "sun", almanac.TWILIGHTS).collect()
    assert {r.event for r in found if r.moment is not None} == {"astronomical"}  # at noon the sun is 13 degrees down
    changes = {r.id: (r.dark, r.change) for r in almanac.mode_changes(frames, cameras).collect()}
    assert changes == {0: (True, None), 1: (False, None)}


def test_days_of_frames(spark):
    """A night keeps the date of its evening; jobs of a night run at noon, those of a day at midnight."""
    times = [dt.datetime(2024, 3, 20, h, 30) for h in (0, 3, 8, 14, 20, 23)]
    frames, cameras = site(spark, 50.0, 0.0, *times)
    rows = almanac.with_day(frames, cameras)
    at = almanac.day_of(F.col("utc"), F.col("day"), F.col("dark"), F.col("before"), F.col("noon"), F.col("after"))
    got = {r.id: (r.dark, r.d, dt.datetime.fromtimestamp(r.stop, dt.UTC)) for r in almanac.next_stop(rows.withColumn("d", at)).collect()}
    assert [got[i][0] for i in range(6)] == [True, True, False, False, True, True]
    assert [got[i][1].day for i in range(6)] == [19, 19, 20, 20, 20, 20]
    assert [(got[i][2].day, round(got[i][2].hour + got[i][2].minute / 60)) for i in range(6)] == [(20, 12), (20, 12), (21, 0), (21, 0), (21, 12), (21, 12)]


def test_next_change_is_at_the_night_altitude(spark):
    frames, cameras = site(spark, 45.0, 10.0, *[dt.datetime(2024, 9, 1, h) for h in range(24)])
    rows = almanac.mode_changes(frames, cameras)
    alt = eph.altitude(eph.sun(F.col("change")), F.col("latitude"), F.col("longitude"), F.col("change"))
    got = rows.select("utc", "dark", "change", alt.alias("alt")).collect()
    assert all(abs(r.alt + 6.2666) < 1e-4 and 0 < r.change - r.utc < 86400 for r in got)
    assert {r.dark for r in got} == {True, False}


def test_roots_are_found_once_a_day(spark, sf_dir):
    """Frames meet their days by an equality join; no halving is done for a frame."""
    from starledger.plans.registry import Tables

    t = Tables(spark, sf_dir)
    plan = almanac.mode_changes(t.frames, t.cameras)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    days = almanac.site_days(t.frames, t.cameras)
    assert days.count() == t.frames.join(t.cameras.select(F.col("id").alias("camera_id")), "camera_id").select("camera_id", F.to_date("create_date")).distinct().count()
