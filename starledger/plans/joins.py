"""Joins (J1-J17)."""

from pyspark.sql import functions as F

from starledger.operators import joins as op
from starledger.operators import polygons as areas

from .registry import query


def _seconds():
    return F.unix_timestamp(F.col("create_date").cast("timestamp"))



@query("select f.id, c.name, f.adu from frames f join cameras c on f.camera_id = c.id where c.id = 5")
def camera_fact_join(t):
    """The dimension is one row, so it is broadcast; the filter reaches the frames' scan."""
    return t.frames.where("camera_id = 5").join(F.broadcast(t.cameras.where("id = 5").select(F.col("id").alias("camera_id"), "name")), "camera_id").select("id", "name", "adu")


@query("select id, camera_id from frames where camera_id in (select id from cameras where not hidden)")
def visible_camera_frames(t):
    """No column of the camera is used, so a semi join does."""
    return t.frames.join(t.cameras.where("not hidden").select(F.col("id").alias("camera_id")), "camera_id", "left_semi").select("id", "camera_id")


@query("select f.id, t.filename as thumbnail from frames f join thumbnails t on f.thumbnail_uuid = t.uuid")
def thumbnail_join(t):
    """J3."""
    return t.frames.join(t.thumbnails.select(F.col("uuid").alias("thumbnail_uuid"), F.col("filename").alias("thumbnail")), "thumbnail_uuid").select("id", "thumbnail")


@query("select f.id, t.filename as thumbnail from frames f left join thumbnails t on f.thumbnail_uuid = t.uuid")
def thumbnail_left_join(t):
    """J6."""
    return t.frames.join(t.thumbnails.select(F.col("uuid").alias("thumbnail_uuid"), F.col("filename").alias("thumbnail")), "thumbnail_uuid", "left").select("id", "thumbnail")


@query("""select v.id, f.id as fits_id, r.id as raw_id from videos v
left join (select * from assets where kind = 'fitsimage' qualify row_number() over (partition by camera_id, create_date order by id) = 1) f on v.camera_id = f.camera_id and v.create_date = f.create_date
left join (select * from assets where kind = 'rawimage' qualify row_number() over (partition by create_date order by id) = 1) r on v.create_date = r.create_date""")
def same_instant_left_join(t):
    """Several rows of an instant resolve to the one of least id; raw frames match by time alone."""
    kind = lambda k, n, *by: t.assets.where(F.col("kind") == k).select(F.col("id").alias(n), *by)
    out = op.first_match_left(t.videos.select("id", "camera_id", "create_date"), kind("fitsimage", "fits_id", "camera_id", "create_date"), ["camera_id", "create_date"], [F.col("fits_id")])
    return op.first_match_left(out, kind("rawimage", "raw_id", "create_date"), ["create_date"], [F.col("raw_id")]).select("id", "fits_id", "raw_id")


_BUNDLE = ("keogram", "startrail", "startrailvideo", "panoramavideo")


@query("select v.id, " + ", ".join(f"{k}.id as {k}_id" for k in _BUNDLE) + " from videos v " + " ".join(f"left join (select camera_id, day_date, night, arg_min(id, (create_date, id)) as id from assets where kind = '{k}' group by all) {k} on v.camera_id = {k}.camera_id and v.day_date = {k}.day_date and v.night = {k}.night" for k in _BUNDLE))
def asset_bundle_left_joins(t):
    """The four lookups of a video are one aggregation of the assets and one join."""
    by = ["camera_id", "day_date", "night"]
    first = [F.min_by(F.when(F.col("kind") == k, F.col("id")), F.when(F.col("kind") == k, F.struct("create_date", "id"))).alias(f"{k}_id") for k in _BUNDLE]
    bundle = t.assets.where(F.col("kind").isin(*_BUNDLE)).groupBy(*by).agg(*first)
    return t.videos.select("id", *by).join(bundle, by, "left").select("id", *[f"{k}_id" for k in _BUNDLE])


_CALIBRATED = """with req as (select id, camera_id, binmode, 16 as bitdepth, gain, cast(floor(exposure) as int) as exposure, cast(stars % 30 as double) - 5 as temp from frames),
setting as (select distinct camera_id, binmode, bitdepth, gain, exposure, temp from req),
met as (select setting.*, c.id as cal, case when c.temp between setting.temp and setting.temp + 5 then 0 else 1 end as tier, c.gain as cg, c.exposure as ce, c.temp as ct, c.create_date as cd from setting join calibrations c
on setting.camera_id = c.camera_id and setting.binmode = c.binmode and setting.bitdepth = c.bitdepth and c.active and c.gain >= setting.gain and c.exposure >= setting.exposure),
best as (select *, row_number() over (partition by camera_id, binmode, bitdepth, gain, exposure, temp order by tier, cg, ce, case when tier = 0 then ct else -ct end, cd desc, cal) as n from met)
select req.id, best.cal as calibration_id, best.tier from req left join best on req.camera_id = best.camera_id and req.binmode = best.binmode and req.bitdepth = best.bitdepth and req.gain = best.gain and req.exposure = best.exposure and req.temp = best.temp and n = 1"""


@query(_CALIBRATED)
def best_calibration(t):
    """The calibration of every frame."""
    return _calibrated(t, t.frames)


query(_CALIBRATED, name="best_calibration_all")(best_calibration)


def _calibrated(t, frames):
    requests = frames.select("id", "camera_id", "binmode", F.lit(16).alias("bitdepth"), "gain", F.floor("exposure").cast("int").alias("exposure"), (F.col("stars") % 30).cast("double").alias("t"))
    requests = requests.withColumn("temp", F.col("t") - 5).drop("t")
    return op.best_match(requests, t.calibrations.where("active"), ["camera_id", "binmode", "bitdepth"], 5.0).select("id", "calibration_id", "tier")


@query("""with s as (select id, camera_id, gain, exclude, floor(epoch(create_date))::bigint as t from frames),
bad as (select * from s where exclude), good as (select * from s where not exclude),
b as (select bad.id, arg_max(good.id, (good.t, good.id)) as i, max(good.t) as t from bad join good on bad.camera_id = good.camera_id and good.t < bad.t group by bad.id),
a as (select bad.id, arg_min(good.id, (good.t, good.id)) as i, min(good.t) as t from bad join good on bad.camera_id = good.camera_id and good.t > bad.t group by bad.id)
select bad.camera_id, bad.id, case when bad.t - b.t <= 3000 then b.i end as before, case when a.t - bad.t <= 3000 then a.i end as after from bad left join b on bad.id = b.id left join a on bad.id = a.id""")
def asof_nearest_pair(t):
    """J8."""
    return op.asof_neighbours(t.frames.select("id", "camera_id", "exclude", _seconds().alias("t")), F.col("exclude"), ["camera_id"], "t", "id", 3000)


@query("""with s as (select id, camera_id, stars, 'c' || (stars % 10) as capture, case stars % 3 when 0 then 'preceding' when 1 then 'bad' else 'following' end as role, floor(epoch(create_date))::bigint as t from frames)
select a.id as target, a.capture, max(b.id) filter (b.role = 'preceding') as preceding, max(b.id) filter (b.role = 'bad') as bad, max(b.id) filter (b.role = 'following') as following
from s a join s b on a.camera_id = b.camera_id and a.capture = b.capture and b.t between a.t - 900 and a.t + 900 where a.stars % 10 = 0 group by a.id, a.capture""")
def diagnostics_triplet(t):
    """The newest file of each role of a frame's capture within a quarter of an hour; the capture's name and role are nested in a document."""
    doc = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), (F.col("stars") % 10).cast("string")).alias("capture_id"), F.element_at(F.array(F.lit("preceding"), F.lit("bad"), F.lit("following")), F.col("stars") % 3 + 1).alias("role"))).alias("roles")))
    return op.capture_triplets(t.frames.select("id", "camera_id", (F.col("stars") % 10 == 0).alias("wanted"), _seconds().alias("t"), doc.alias("doc")), 900)


@query("""with s as (select id, camera_id, detections, stars, floor(epoch(create_date))::bigint as t from frames)
select a.id as target, count(*) as frames, min(b.id) as first, max(b.id) as last from s a join s b on a.camera_id = b.camera_id and b.t >= a.t - 600 and b.t <= a.t + 1200 where a.stars = 77 group by a.id""")
def interval_clip(t):
    """Ten minutes before to twenty after each target frame, both ends closed."""
    rows = t.frames.select("id", "camera_id", "stars", _seconds().alias("t"))
    targets = rows.where("stars = 77").select(F.col("id").alias("target"), "camera_id", F.col("t").alias("at"))
    return op.interval_join(targets, rows, ["camera_id"], "t", 600, 1200).groupBy("target").agg(F.count("*").alias("frames"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("""with grid as (select lon, lat, (lon * 7 + lat * 13 + 1000) % 50 as value from range(360) a(lon), range(-90, 91) b(lat)),
p as (select id, cast(((cast(floor(longitude) as int) * 5) % 360 + 360) % 360 as int) as lon, cast(floor(latitude) as int) as lat from cameras)
select p.id, count(*) as cells, max(value) as max_value, round(avg(value), 6) as mean_value from p join grid on ((grid.lon - p.lon) % 360 + 360 + 9) % 360 <= 18 and grid.lat between p.lat - 7 and p.lat + 7 group by p.id""")
def grid_box(t):
    """The box wraps at 0/360 degrees."""
    # the feed is a fixed grid of 360 by 181 whole degrees
    grid = t.spark.range(360).select(F.col("id").cast("int").alias("lon"), F.explode(F.sequence(F.lit(-90), F.lit(90))).alias("lat")).withColumn("value", ((F.col("lon") * 7 + F.col("lat") * 13 + 1000) % 50).cast("bigint"))
    points = t.cameras.select("id", F.pmod(F.floor("longitude").cast("int") * 5, F.lit(360)).alias("lon"), F.floor("latitude").cast("int").alias("lat"))
    return op.grid_lookup(points, grid, 9, 7).withColumn("mean_value", F.round("mean_value", 6))


#: Outlines and holes in a square of four: open on top, with a hole, touching itself.
SHAPES = (
    (((0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)),),
    (((0, 0), (4, 0), (4, 4), (0, 4)), ((1, 1), (3, 1), (3, 3), (1, 3))),
    (((0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)),),
)


def _smoke(t):
    """A polygon for each nation, of three forms, sizes and ranks."""
    n = F.col("n_nationkey")
    x, y, size = n * 4 - 12.0, F.col("n_regionkey") * 10.0 - 2, 0.75 + n % 4 * 0.5
    ring = lambda points: F.array(*[F.struct((x + size * a).alias("x"), (y + size * b).alias("y")) for a, b in points])
    forms = [F.array(*[ring(r) for r in form]) for form in SHAPES]
    return t.nation.select(n.alias("polygon"), F.when(n % 3 == 0, forms[0]).when(n % 3 == 1, forms[1]).otherwise(forms[2]).alias("rings"), (F.floor(n / 3) % 3).cast("int").alias("rank"))


_EDGES = " union all ".join(f"select n_nationkey as polygon, {ax}.0 as ax, {ay}.0 as ay, {bx}.0 as bx, {by}.0 as by_ from nation where n_nationkey % 3 = {k}" for k, form in enumerate(SHAPES) for ring in form for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))
_SIDE = "(({x}) - x1) * (y2 - y1) - (({y}) - y1) * (x2 - x1)"
_CORNERS = ", ".join(_SIDE.format(x=f"longitude {i} 0.5", y=f"latitude {j} 0.5") for i in "+-" for j in "+-")


@query(f"""with p as (select n_nationkey as polygon, n_nationkey * 4 - 12.0::double as x, n_regionkey * 10.0::double - 2 as y, 0.75::double + n_nationkey % 4 * 0.5 as size, (n_nationkey // 3 % 3)::int as rank from nation),
e as (select polygon, rank, x + size * ax as x1, y + size * ay as y1, x + size * bx as x2, y + size * by_ as y2 from p join ({_EDGES}) using (polygon)),
m as (select id, polygon, rank, bool_or(least(x1, x2) <= longitude + 0.5 and greatest(x1, x2) >= longitude - 0.5 and least(y1, y2) <= latitude + 0.5 and greatest(y1, y2) >= latitude - 0.5 and least({_CORNERS}) <= 0 and greatest({_CORNERS}) >= 0) as touched,
 count(*) filter ((y1 > latitude) <> (y2 > latitude) and longitude < x1 + (latitude - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1 as inside from cameras, e group by all)
select id, min(case when touched or inside then rank end) as rank, count(*) filter (touched or inside) as areas from m group by id""")
def smoke_polygons(t):
    """The worst smoke that a box of half a degree around each camera meets, and how many areas it meets."""
    smoke, x, y = _smoke(t), F.col("longitude"), F.col("latitude")
    boxes = t.cameras.select("id", (x - 0.5).alias("left"), (y - 0.5).alias("low"), (x + 0.5).alias("right"), (y + 0.5).alias("high"))
    met = areas.boxes_meet(boxes, smoke.select("polygon", "rings"), 4.0).join(smoke.select("polygon", "rank"), "polygon")
    worst = met.groupBy("id").agg(F.min("rank").alias("rank"), F.count("*").alias("areas"))
    return t.cameras.select("id").join(worst, "id", "left").select("id", "rank", F.coalesce("areas", F.lit(0)).alias("areas"))


_SKY = ("camera_id", "day_date")


def _sky_sides(t):
    """Even and odd frames, which stand for stars and detections."""
    points = t.frames.select(*_SKY, "id", ((F.col("id") * 37) % 1000).alias("x"), ((F.col("id") * 91) % 1000).alias("y"))
    side = lambda k, p: points.where(F.col("id") % 2 == k).select(*_SKY, F.col("id").alias(f"{p}id"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    return side(0, "l"), side(1, "r")


def _sky_pairs(t, radius):
    """Stars against detections within a camera's day."""
    return op.nearest_in_cells(*_sky_sides(t), radius, _SKY)


_CANDIDATES = """with s as (select id, camera_id, day_date, (id * 37) % 1000 as x, (id * 91) % 1000 as y from frames)
select a.camera_id, a.day_date, count(*) as pairs, cast(sum(a.id) as bigint) as left_ids, cast(sum(b.id) as bigint) as right_ids from s a join s b on a.camera_id = b.camera_id and a.day_date = b.day_date and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1600 where a.id % 2 = 0 and b.id % 2 = 1 group by all"""


@query(_CANDIDATES)
def star_match_candidates(t):
    """What ``star_match`` chooses from: stars and detections within a radius, by cells."""
    return _sky_pairs(t, 40.0).groupBy(*_SKY).agg(F.count("*").alias("pairs"), F.sum("lid").alias("left_ids"), F.sum("rid").alias("right_ids"))


query(_CANDIDATES, name="star_match_candidates_all")(star_match_candidates)


@query()
def star_match(t):
    """Each star's own detection in its camera's day, the closest pairs first; tests hold it against one ordered pass."""
    return op.greedy_match(*_sky_sides(t), 40.0, _SKY).select("lid", "rid", "distance")


@query("select distinct n.name, c.id from (select 'Supplier#000000004' as name union all select 'cam-4' union all select 'SUPPLIER#000000006' union all select 'none') n join cameras c on n.name in (c.name, c.name_alt1, c.name_alt2)")
def alias_identity_join(t):
    """J14."""
    names = t.spark.createDataFrame([("Supplier#000000004",), ("cam-4",), ("SUPPLIER#000000006",), ("none",)], "name string")
    return op.by_any_name(names, t.cameras, ["name", "name_alt1", "name_alt2"])


@query("select p_brand, p_type, arg_max(p_name, p_partkey) as line, max(p_partkey) as id from part group by p_brand, p_type")
def latest_elements(t):
    """The newest orbital elements of each group and title."""
    return t.part.groupBy("p_brand", "p_type").agg(F.max_by("p_name", "p_partkey").alias("line"), F.max("p_partkey").alias("id"))


@query("select id, kind from (select id, 'video' as kind from videos v where not exists (select 1 from lineitem where l_orderkey = v.id))")
def orphan_anti_join(t):
    """Rows whose file is not there."""
    return t.videos.join(t.lineitem.select(F.col("l_orderkey").alias("id")), "id", "left_anti").select("id", F.lit("video").alias("kind"))


@query("select f.id, k.adu as sample from frames f join (select camera_id, floor(epoch(create_date))::bigint as ts, adu from frames where stars < 50) k on f.camera_id = k.camera_id and floor(epoch(f.create_date))::bigint = k.ts")
def keogram_sample_join(t):
    """J17."""
    keogram = t.frames.where("stars < 50").select("camera_id", _seconds().alias("ts"), F.col("adu").alias("sample"))
    return t.frames.select("id", "camera_id", _seconds().alias("ts")).join(keogram, ["camera_id", "ts"]).select("id", "sample")
