"""Feeds, sinks and secondary operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from starledger.operators import ordering
from starledger.operators import secondary as op
from starledger.sources import feeds, sinks

from .registry import query


@query("select id, kp from (select id, (data->>'k')::double as kp from frames)")
def json_feed(t):
    """S6."""
    return t.frames.select("id", F.from_json("data", "k double").alias("d")).select("id", F.col("d.k").alias("kp"))


@query("select id as line, strftime(create_date, '%Y-%m-%d_%H:%M') as observed, stars::int as north, (stars + 5)::int as south from frames where id % 3 > 0")
def power_feed(t):
    """Every third line is a comment."""
    stamp = F.date_format("create_date", "yyyy-MM-dd_HH:mm")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("# "), stamp)).otherwise(F.concat_ws("   ", stamp, stamp, F.col("stars").cast("string"), (F.col("stars") + 5).cast("string")))
    return feeds.power_lines(t.frames.select(F.col("id").alias("line"), text.alias("value")))


@query("select id, folder, 4::int as points, x as first_x from (select n_nationkey as id, 'Smoke (' || s || ')' as folder, n_nationkey + k as x from nation, (values ('Heavy', 0.0::double), ('Light', 10.0::double)) f(s, k))")
def kml_feed(t):
    """S8."""
    part = lambda name, k: F.concat(F.lit(f"<Folder><name>Smoke ({name})</name><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>"), (F.col("id") + k).cast("string"), F.lit(",1,0 2,3,0 4,5,0 "), (F.col("id") + k).cast("string"), F.lit(",1,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>"))
    docs = t.nation.select(F.col("n_nationkey").cast("double").alias("id")).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("<kml><Document>"), part("Heavy", 0), part("Light", 10), F.lit("</Document></kml>")).alias("kml"))
    rings = feeds.kml_rings(docs)
    return rings.select("id", "folder", F.size("ring").alias("points"), F.col("ring")[0]["x"].alias("first_x"))


@query("""select p_brand as grp, row_number() over (partition by p_brand order by p_partkey) - 1 as record, rtrim(substring(p_name, 1, 24)) as title, rpad('1 ' || p_partkey, 69, '0') as line1, rpad('2 ' || p_partkey, 69, '0') as line2
from part where p_brand <> 'Brand#3'""")
def element_feed(t):
    """One group has a short line, so none of its records is taken."""
    line = lambda n: F.rpad(F.concat(F.lit(f"{n} "), F.col("p_partkey").cast("string")), 69, "0")
    second = F.when((F.col("p_brand") == "Brand#3") & (F.col("at") == 2), F.lit("2 short")).otherwise(line(2))
    numbered = t.part.withColumn("at", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    rows = numbered.select(F.col("p_brand").alias("grp"), "at", F.posexplode(F.array(F.substring("p_name", 1, 24), line(1), second)).alias("k", "value")).select("grp", (F.col("at") * 3 + F.col("k")).alias("line"), "value")
    return feeds.element_records(rows).select("grp", "record", "title", "line1", "line2")


@query("select flight, lat, lon, height from (select case when stars % 4 = 0 then 'hex' || id else 'FL' || id end as flight, sqm as lat, sqm - 20 as lon, adu as height, 1706000000 + id as now from frames) where abs(1706000500 - now) <= 60")
def aircraft_feed(t):
    """S10, Q9."""
    plane = F.struct(
        F.when(F.col("stars") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("FL"), F.col("id").cast("string"), F.lit(" "))).alias("flight"), F.concat(F.lit("hex"), F.col("id").cast("string")).alias("hex"), F.col("sqm").alias("lat"), (F.col("sqm") - 20).alias("lon"),
        F.when(F.col("stars") % 2 == 0, F.col("adu")).alias("alt_geom"), F.when(F.col("stars") % 2 == 1, F.col("adu")).alias("altitude"),
    )
    doc = F.to_json(F.struct((F.col("id") + 1706000000).cast("double").alias("now"), F.array(plane).alias("aircraft")))
    return feeds.aircraft(t.frames.select(doc.alias("value")), F.lit(1706000500.0)).select("flight", "lat", "lon", "height")


@query("select create_date as ts, slot::int as slot, case slot when 0 then adu when 1 then sqm else moonphase end as value from frames, range(3) s(slot) where not (slot = 0 and stars % 3 = 0)")
def sensor_slots(t):
    """S11, S12."""
    return feeds.sensor_slots(t.frames.select(F.col("create_date").alias("ts"), F.array(F.when(F.col("stars") % 3 != 0, F.col("adu")), F.col("sqm"), F.col("moonphase")).alias("values")))


@query("select (n_nationkey * 14.5)::double as ra, (n_nationkey - 12)::double as dec, (n_nationkey / 4.0)::double as vmag from nation where n_nationkey / 4.0 <= 4.5 and n_nationkey % 5 > 0")
def star_catalogue(t):
    """Short rows are skipped."""
    n = F.col("n_nationkey").cast("double")
    rows = t.nation.select(F.when(F.col("n_nationkey") % 5 == 0, F.array(n, n / 4)).otherwise(F.array(n, n / 4, n * 14.5, n - 12)).alias("star"))
    return feeds.catalogue(rows, 4.5)


@query("select 'sky/' || camera_id || '/' || k as topic, v as payload from (select camera_id, max(stars)::varchar as stars, count(*)::varchar as frames from frames group by camera_id) unpivot (v for k in (stars, frames))")
def topic_values(t):
    """K3."""
    return sinks.topic_values(t.frames.groupBy("camera_id").agg(F.max("stars").alias("stars"), F.count("*").alias("frames")), "camera_id")


@query("select id, 'image' as event, floor(epoch(create_date))::bigint as stamp, camera_id from frames")
def event_documents(t):
    """K2, K4: documents written for the bus, read back."""
    docs = sinks.events(t.frames.select("id", "camera_id", "create_date"), "image", "create_date")
    read = docs.select(F.from_json("value", "event string, timestamp bigint, data struct<id:bigint,camera_id:int>").alias("d"))
    return read.select("d.data.id", "d.event", F.col("d.timestamp").alias("stamp"), "d.data.camera_id")


@query("select id, make_date(2024, 1, (id % 28)::int + 1)::timestamp as made from frames where make_date(2024, 1, (id % 28)::int + 1)::timestamp < timestamp '2024-01-31 00:00:00' - interval 20 days")
def expired_snapshots(t):
    """K5."""
    made = t.frames.select("id", F.make_date(F.lit(2024), F.lit(1), (F.col("id") % 28 + 1).cast("int")).cast("timestamp_ntz").alias("made"))
    return sinks.expired_snapshots(made, "2024-01-31", 20)


@query("""select id, min(adu) over l as min_distance, max(adu) over l as max_distance, round(avg(adu) over l, 6) as mean_distance, min(sqm) over l as min_energy, max(sqm) over l as max_energy, round(avg(sqm) over l, 6) as mean_energy,
coalesce(count(adu) over l, 0)::bigint as strikes, coalesce(sum(case when exclude then 1 else 0 end) over l, 0)::bigint as disturbers, coalesce(sum(detections) over l, 0)::bigint as noise
from frames window l as (partition by camera_id order by create_date, id rows between 20 preceding and 1 preceding)""")
def lightning_summary(t):
    """The twenty polls before each poll; its distances and energies are lists."""
    polls = t.frames.select("id", "camera_id", "create_date", F.array("adu").alias("distances"), F.array("sqm").alias("energies"), F.col("exclude").cast("int").alias("disturbers"), F.col("detections").alias("noise"))
    return op.lightning(polls, 20).withColumns({c: F.round(c, 6) for c in ("mean_distance", "mean_energy")}).withColumn("strikes", F.col("strikes").cast("bigint"))


@query("select id, name, unit, round_even(value * 100, 0) / 100 as value from (select id, (['heater', 'sky', 'case', 'wind'])[slot + 1] as name, (['%', 'C', 'C', 'm/s'])[slot + 1] as unit, slot, case slot when 0 then moonphase when 1 then sqm when 2 then detections::double else ovation_max::double end as value from frames, range(4) s(slot)) where value <> 0 or slot in (0, 1)")
def named_sensors(t):
    """X2."""
    names = t.spark.createDataFrame([(0, "heater", "%", True), (1, "sky", "C", True), (2, "case", "C", False), (3, "wind", "m/s", False)], "slot int, name string, unit string, zeros boolean")
    readings = t.frames.select("id", F.array("moonphase", "sqm", F.col("detections").cast("double"), F.col("ovation_max").cast("double")).alias("values"))
    return op.named_sensors(readings, names)


@query("select id, case when stars % 2 = 0 then adu else 0.0 end as wind, case when stars % 3 = 0 then sqm else 0.0 end as rain, stars::double as first_value from frames")
def weather_flatten(t):
    """Parts of the document may be missing."""
    wind = F.when(F.col("stars") % 2 == 0, F.struct(F.col("adu").alias("speed")))
    rain = F.when(F.col("stars") % 3 == 0, F.struct(F.col("sqm").alias("h1")))
    doc = F.to_json(F.struct(wind.alias("wind"), rain.alias("rain"), F.array(F.struct(F.struct(F.col("stars").cast("double").alias("ActualValue")).alias("Value"))).alias("k")))
    return op.weather(t.frames.select("id", doc.alias("doc")))


@query("select id, last_value(case when stars % 5 = 0 then adu end ignore nulls) over (partition by camera_id order by create_date, id rows unbounded preceding) as reading from frames")
def throttled_readings(t):
    """Between polls the last reading holds."""
    return ordering.held(t.frames, F.when(F.col("stars") % 5 == 0, F.col("adu")))


def _seed(n):
    """SQL of the n-th seed: the newest row of an exposure close to no seed's before it."""
    far = "".join(f" and not exists (select 1 from s{i} where s{i}.camera_id = f.camera_id and abs(s{i}.exposure - f.exposure) <= 0.05 * greatest(abs(s{i}.exposure), abs(f.exposure)))" for i in range(1, n))
    return f"s{n} as (select camera_id, id, exposure from frames f where true{far} qualify row_number() over (partition by camera_id order by create_date desc, id) = 1)"


@query(f"""with recursive {", ".join(_seed(n) for n in (1, 2, 3))},
seeds as (select id from s1 union all select id from s2 union all select id from s3),
o as (select id, camera_id, file_size, id in (select id from seeds) as seed, row_number() over (partition by camera_id order by case when id in (select id from seeds) then 0 else 1 end, create_date desc, id) as n from frames),
r as (select distinct camera_id, 0::bigint as n, null::bigint as id, false as seed, false as taken, 20 as files, 100000::bigint as size from frames
union all select camera_id, n, id, seed, ok, case when ok then files - 1 else files end, case when ok then size - file_size else size end
 from (select r.camera_id, o.n, o.id, o.seed, o.file_size, r.files, r.size, r.files > 0 and o.file_size <= r.size as ok from r join o on o.camera_id = r.camera_id and o.n = r.n + 1) s)
select id, camera_id, taken, seed from r where taken""")
def budget_selection(t):
    """Each choice depends on the room that those before it left."""
    return op.within_budget(t.frames.select("id", "camera_id", "create_date", "exposure", "file_size"), files=20, size=100_000, levels=3, tolerance=0.05)


@query("select id, coalesce(saved, computed) as signature from (select id, case when stars % 2 = 0 then adu end as saved, sqm as computed from frames)")
def saved_signatures(t):
    """X9."""
    saved = t.frames.where("stars % 2 = 0").select("id", F.col("adu").alias("saved"))
    return t.frames.select("id", F.col("sqm").alias("computed")).join(saved, "id", "left").select("id", F.coalesce("saved", "computed").alias("signature"))


#: Ids to a slot in which missing uploads are numbered.
UPLOAD_SLOT = 100_000


@query("select kind, id, floor((row_number() over (partition by kind order by id) - 1) / 50)::bigint as batch from (select kind, id from assets where not uploaded union all select 'video', id from videos where not uploaded)")
def upload_batches(t):
    """What is missing, in batches of fifty of a kind."""
    rows = t.assets.where("not uploaded").select("kind", "id").unionByName(t.videos.where("not uploaded").select(F.lit("video").alias("kind"), "id"))
    # slots of ids: a kind of many rows is many tasks
    numbered = ordering.placed(rows, ["kind"], [F.floor(F.col("id") / UPLOAD_SLOT)], [F.col("id")])
    return numbered.select("kind", "id", F.floor((F.col("at") - 1) / 50).alias("batch"))


_LADDER = "with l as (select distinct gain, binmode, exposure from calibrations)"


@query(f"{_LADDER} select gain, binmode, exposure, round(sum(exposure * 5 + 2.0::double) over (partition by gain, binmode order by exposure desc rows unbounded preceding), 6) as remaining from l")
def dark_runtime(t):
    """Seconds that are left, the longest exposures last; 5 frames an exposure and 2 s around them."""
    ladder = t.calibrations.select("gain", "binmode", "exposure").distinct()
    w = Window.partitionBy("gain", "binmode").orderBy(F.desc("exposure")).rowsBetween(Window.unboundedPreceding, 0)
    return ladder.withColumn("remaining", F.round(F.sum(F.col("exposure") * 5 + 2.0).over(w), 6))


@query("select e.e::int as exposure, g.gain, b.binmode from range(1, 16) e(e), (select distinct gain from calibrations where gain <= 200) g, (values (1), (2)) b(binmode)")
def dark_ladder(t):
    """Every exposure of a ladder at every gain and binning; the steps are parameters."""
    steps = t.calibrations.where("gain <= 200").select("gain").distinct()
    return steps.select(F.explode(F.sequence(F.lit(1), F.lit(15))).alias("exposure"), "gain").select("exposure", "gain", F.explode(F.array(F.lit(1), F.lit(2))).alias("binmode"))


@query("select camera_id, arg_max(id, (create_date, id)) as id from frames where create_date > timestamp '2024-01-20 00:00:00' - interval 900 minutes and create_date <= timestamp '2024-01-20 00:00:00' group by camera_id")
def recent_frame(t):
    """X14."""
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return t.frames.where((F.col("create_date") > now - F.make_dt_interval(mins=F.lit(900))) & (F.col("create_date") <= now)).groupBy("camera_id").agg(F.max_by("id", F.struct("create_date", "id")).alias("id"))


@query("select id from frames where not (create_date > timestamp '2024-01-29 00:00:00' - interval 16 minutes)")
def flush_recent(t):
    """X15."""
    return t.frames.where(~(F.col("create_date") > F.lit("2024-01-29").cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(16)))).select("id")


@query("select cast(year(create_date) as int) as y, cast(month(create_date) as int) as m, floor(epoch(create_date)::bigint / 60)::bigint as bucket, round(avg(adu), 6) as r from frames group by all")
def year_keogram(t):
    """X20."""
    return t.frames.groupBy(F.year("create_date").alias("y"), F.month("create_date").alias("m"), F.floor(F.round(F.unix_micros(F.col("create_date").cast("timestamp")) / 1e6) / 60).cast("bigint").alias("bucket")).agg(F.round(F.avg("adu"), 6).alias("r"))
