"""Orbits against closed forms, and satellites over cameras against all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from starledger.operators import satellites

ORBIT = "title string, epoch double, inclination double, node double, eccentricity double, perigee double, anomaly double, motion double"
EPOCH = 1_704_067_200.0


def placed(spark, rows, *times):
    df = spark.createDataFrame(rows, ORBIT).withColumn("t", F.explode(F.array(*map(F.lit, times))))
    return satellites.propagated(df, "t").orderBy("title", "t").collect()


def test_elements_of_a_record(spark):
    """A published record of the space station."""
    one = "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927"
    two = "2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"
    r = satellites.elements(spark.createDataFrame([("ISS (ZARYA)", one, two), ("bad", one, two.replace("51.6416", "xx.6416"))], "title string, line1 string, line2 string")).collect()
    assert (r[0].inclination, r[0].node, r[0].eccentricity, r[0].perigee, r[0].anomaly, r[0].motion) == (51.6416, 247.4627, 0.0006703, 130.5360, 325.0288, 15.72125391)
    assert abs(r[0].epoch - (1221868800 + 0.51782528 * 86400)) < 1e-3  # 2008 September 20
    assert r[1].inclination is None and r[1].node == 247.4627


def test_circles_and_ellipses(spark):
    """Radii by Kepler's third law, distances at the apsides, and the drift of the node of a sun-synchronous orbit."""
    n = 14.57
    a = (398600.8 / (n * 2 * math.pi / 86400) ** 2) ** (1 / 3)
    rows = [("circle", EPOCH, 0.0, 0.0, 0.0, 0.0, 10.0, n), ("far", EPOCH, 30.0, 40.0, 0.7, 50.0, 180.0, 2.0), ("near", EPOCH, 30.0, 40.0, 0.7, 50.0, 0.0, 2.0)]
    got = {r.title: r for r in placed(spark, rows, EPOCH)}
    radius = lambda r: math.sqrt(r.x**2 + r.y**2 + r.z**2)
    assert abs(radius(got["circle"]) - a) < 1e-6 and abs(got["circle"].z) < 1e-9
    wide = (398600.8 / (2.0 * 2 * math.pi / 86400) ** 2) ** (1 / 3)
    assert abs(radius(got["far"]) - wide * 1.7) < 1e-6 and abs(radius(got["near"]) - wide * 0.3) < 1e-6
    # the plane of a sun-synchronous orbit turns with the sun, about 0.9856 degrees a day
    polar = placed(spark, [("s", EPOCH, 98.2, 0.0, 0.0, 0.0, 90.0, 14.571)], EPOCH, EPOCH + 86400)
    normal = spark.createDataFrame([("s", EPOCH, 98.2, 0.0, 0.0, 0.0, 0.0, 14.571)], ORBIT).withColumn("t", F.explode(F.array(*[F.lit(EPOCH + 86400 * 10 + k) for k in (0, 600)])))
    p, q = ((r.x, r.y, r.z) for r in satellites.propagated(normal, "t").orderBy("t").collect())
    cross = (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    assert abs(math.degrees(math.atan2(cross[0], -cross[1])) / 10 - 0.9856) < 0.01 and len(polar) == 2


def test_a_satellite_that_stays_over_its_place(spark):
    rows = spark.createDataFrame([("geo", EPOCH, 0.0, 75.0, 0.0, 0.0, 0.0, 1.0027379)], ORBIT).withColumn("t", F.explode(F.array(*[F.lit(EPOCH + h * 3600.0) for h in range(0, 24, 3)])))
    got = satellites.below(satellites.propagated(rows, "t"), "t").collect()
    places = [r.sublon for r in got]
    assert max(places) - min(places) < 0.2 and all(abs(r.radius - 42164) < 15 for r in got)
    site = satellites.propagated(rows, "t").withColumns({"latitude": F.lit(0.0), "longitude": F.lit(float(places[0]))})
    assert all(r.alt > 89 and abs(r.distance - (42164 - 6378)) < 20 for r in satellites.seen(site, "t").collect())


def test_shadow(spark):
    """At a March noon in Greenwich the sun stands over 0, 0: what is over 180 is in the shadow if low, and in the sun if it stands aside."""
    noon = 1_710_936_000.0
    rows = spark.createDataFrame([("a", -7000.0, 0.0), ("b", -7000.0, 6500.0), ("c", 7000.0, 0.0)], "title string, along double, up double")
    at = rows.select("title", F.lit(noon).alias("t"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.col("along").alias("x"), F.lit(0.0).alias("y"), F.col("up").alias("z"))
    assert {r.title: r.lit for r in satellites.seen(at, "t").collect()} == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize("least", [5.0, 40.0])
def test_cells_lose_no_satellite(spark, least):
    """Slots and cells give what all pairs of rows and satellites give, near the poles and the date line too."""
    catalogue = spark.createDataFrame([(f"s{k}", EPOCH, 10.0 * k % 180, 37.0 * k % 360, (k % 5) * 0.05 if k % 7 else 0.0, 53.0 * k % 360, 71.0 * k % 360, 2.0 + k % 6 if k % 5 else 13.5 + k % 3) for k in range(40)], ORBIT)
    sites = [(lat, lon) for lat in (-89.0, -47.0, 0.0, 31.0, 88.0) for lon in (-179.5, -60.0, 0.0, 179.9)]
    rows = spark.createDataFrame([(i, EPOCH + 977.0 * i, *sites[i % len(sites)]) for i in range(120)], "id int, utc double, latitude double, longitude double")
    found = {(r.id, r.title) for r in satellites.visible(rows, catalogue, least).collect()}
    every = satellites.below(satellites.seen(satellites.propagated(rows.crossJoin(catalogue), "utc"), "utc"), "utc")
    want = {(r.id, r.title) for r in every.where((F.col("alt") >= least) & F.col("lit") & (F.col("radius") > satellites.EARTH_RADIUS)).collect()}
    assert found == want and len(want) > 50
