"""Projections, predicates and scalar text and date functions."""

from pyspark.sql import functions as F

from starledger.operators import filters as op

from .registry import query

ROOT = "/srv/frames/images"


@query("select id, create_date, camera_id from frames")
def scan_projection(t):
    """S1, S2."""
    return t.frames.select("id", "create_date", "camera_id")


@query("select id, adu from frames where camera_id = 3 and night and not exclude and detections >= 2")
def filter_conjunction(t):
    """P1, P10, P11."""
    return op.optional(t.frames, F.col("camera_id") == 3, F.col("night"), ~F.col("exclude"), F.col("detections") >= 2).select("id", "adu")


@query("select id, remote_url, s3_key from frames where (remote_url is not null or s3_key is not null) and kpindex is null")
def filter_disjunction_null(t):
    """P2, P3, P12."""
    return op.optional(t.frames, op.available(local=False), None, F.col("kpindex").isNull()).select("id", "remote_url", "s3_key")


@query("""select id, 'after' as rule from frames where create_date > timestamp '2024-01-10 00:00:00' and create_date < timestamp '2024-01-11 00:00:00'
union all select id, 'closed' from frames where create_date between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-05 06:00:00'
union all select id, 'half' from frames where create_date >= timestamp '2024-01-07 00:00:00' and create_date < timestamp '2024-01-08 00:00:00'""")
def timestamp_ranges(t):
    """P4."""
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    rules = (("after", "2024-01-10", "2024-01-11", "()"), ("closed", "2024-01-05", "2024-01-05 06:00:00", "[]"), ("half", "2024-01-07", "2024-01-08", "[)"))
    hit = F.array_compact(F.array(*[F.when(op.between("create_date", day(a), day(b), ends), F.lit(rule)) for rule, a, b, ends in rules]))
    return t.frames.where("create_date >= timestamp_ntz'2024-01-05' and create_date < timestamp_ntz'2024-01-11'").select("id", F.explode(hit).alias("rule"))


@query("select id, day_date, night from frames where day_date < date '2024-01-31' - 10 and night union all select id, day_date, night from frames where day_date < date '2024-01-31' - 20 and not night")
def retention_cutoff(t):
    """P5: night rows keep for 10 days, day rows for 20."""
    as_of = F.lit("2024-01-31").cast("date")
    return t.frames.where((F.col("night") & op.older_than("day_date", as_of, 10)) | (~F.col("night") & op.older_than("day_date", as_of, 20))).select("id", "day_date", "night")


@query("select id, event_type from frames where event_type in ('view', 'click')")
def filter_in_list(t):
    """P6."""
    return t.frames.where(F.col("event_type").isin("view", "click")).select("id", "event_type")


@query("select id from frames where data->>'k' in ('1', '2', '42')")
def json_predicate(t):
    """P7."""
    return t.frames.where(op.json_in("data", "$.k", ["1", "2", "42"])).select("id")


@query("select id, case when stars % 2 = 1 then true else false end as odd from frames where stars % 2 = 1")
def json_boolean(t):
    """P8."""
    flagged = t.frames.withColumn("doc", F.concat(F.lit('{"night": '), F.when(F.col("stars") % 2 == 1, "true").otherwise("false"), F.lit("}")))
    return flagged.where(op.json_flag("doc", "$.night")).select("id", op.json_flag("doc", "$.night").alias("odd"))


@query("select id, camera_id from frames where id % 7 = 0")
def modulo_sample(t):
    """P9."""
    return t.frames.where(F.col("id") % 7 == 0).select("id", "camera_id")


@query("""select id, coalesce(remote_url, 's3://store/' || s3_key, 'images/' || case when starts_with(filename, '/srv/frames/images/') then substring(filename, 20) else filename end) as url,
'images/' || case when starts_with(filename, '/srv/frames/images/') then substring(filename, 20) else filename end as local_url from frames""")
def url_resolution(t):
    """P15, P16."""
    return t.frames.select("id", op.asset_url(ROOT, "s3://store", local=False).alias("url"), op.asset_url(ROOT, "s3://store", local=True).alias("local_url"))


@query("select id, coalesce(day_year, cast(year(day_date) as int)) as y, coalesce(day_month, cast(month(day_date) as int)) as m from videos")
def coalesce_date_parts(t):
    """P13, F5."""
    return t.videos.select("id", op.date_part_or("day_year", F.year("day_date")).alias("y"), op.date_part_or("day_month", F.month("day_date")).alias("m"))


@query("select id, cast(year(create_date) as int) as create_date_year, cast(month(create_date) as int) as create_date_month, cast(day(create_date) as int) as create_date_day, cast(hour(create_date) as int) as create_date_hour from frames")
def date_parts(t):
    """P14, P18, F1."""
    return op.with_date_parts(t.frames.select("id", "create_date"), "create_date").drop("create_date")


@query("""select id, case when ok then kpindex else 0.0 end as kpindex, case when ok then ovation_max else 0 end as ovation_max, case when ok then smoke_rating else -1 end as smoke_rating, case when ok then moonphase else -1.0 end as moonphase
from (select *, kpindex is not null and ovation_max is not null and smoke_rating is not null and moonphase is not null as ok from frames)""")
def all_or_defaults(t):
    """P19."""
    return t.frames.select("id", *op.all_or_defaults({"kpindex": 0.0, "ovation_max": 0, "smoke_rating": -1, "moonphase": -1.0}))


@query("select f.id, f.filename from frames f join pages p on f.id = p.page_id where length(p.html) > 3000")
def existing_nonempty_files(t):
    """Frames whose file is listed and long enough; a listing holds name and length."""
    listing = t.pages.select(F.col("page_id").alias("id"), F.length("html").alias("length")).where("length > 3000")
    return t.frames.join(listing, "id", "left_semi").select("id", "filename")


@query("select id, strftime(create_date, '%Y%m%d') as day, strftime(create_date, '%H:%M:%S') as clock, strftime(create_date, '%B') as month, printf('gain %d, %03d stars', gain, stars) as label from frames")
def label_templates(t):
    """P21, F2, F6."""
    d = lambda f: F.date_format("create_date", f)
    return t.frames.select("id", d("yyyyMMdd").alias("day"), d("HH:mm:ss").alias("clock"), d("MMMM").alias("month"), F.format_string("gain %d, %03d stars", "gain", "stars").alias("label"))


@query("select id from (select id, row_number() over (partition by camera_id order by create_date, id) as n from frames) where n % 5 = 0")
def every_fifth_frame(t):
    """P22, A25."""
    return op.every_nth(t.frames, 5, [F.col("create_date"), F.col("id")], ["camera_id"], [F.to_date("create_date")]).select("id")


@query("select id, cast(json_extract_string(doc, '$.a') as varchar) as a from (select id, json_object('a', stars::varchar, 'url', 'x', 'id', id::varchar) as doc from frames)")
def metadata_keys_kept(t):
    """Keys that belong to the receiving side never overwrite."""
    doc = F.to_json(F.struct(F.col("stars").cast("string").alias("a"), F.lit("x").alias("url"), F.col("id").cast("string").alias("id")))
    left = t.frames.withColumn("m", op.without_keys_of(doc, ["url", "id"]))
    return left.select("id", F.col("m")["a"].alias("a"))


@query("select id, epoch(create_date)::bigint as epoch, create_date + to_seconds(utc_offset - 3600) as shifted from (select f.id, f.create_date, c.utc_offset from frames f join cameras c on f.camera_id = c.id)")
def epoch_and_offset(t):
    """F3, F4."""
    moved = t.frames.join(t.cameras.select(F.col("id").alias("camera_id"), "utc_offset"), "camera_id")
    # whole seconds, as the stored value is an integer; halves go to the even one
    seconds = F.rint(F.unix_micros(F.col("create_date").cast("timestamp")) / 1e6).cast("bigint")
    return moved.select("id", seconds.alias("epoch"), F.expr("create_date + make_dt_interval(0, 0, 0, utc_offset - 3600)").alias("shifted"))


@query("""select id, trim(upper(event_type)) as kind, substring(filename, 1, 20) as short, regexp_extract(filename, '([0-9]+)\\.jpg$', 1) as number, filename similar to '.*[02468]\\.jpg' as even,
coalesce(data->>'missing', data->>'k') as nested from frames""")
def text_functions(t):
    """F6, F7, F8."""
    return t.frames.select(
        "id", F.trim(F.upper("event_type")).alias("kind"), F.substring("filename", 1, 20).alias("short"), F.regexp_extract("filename", r"([0-9]+)\.jpg$", 1).alias("number"),
        F.col("filename").rlike(r"[02468]\.jpg$").alias("even"), F.coalesce(F.get_json_object("data", "$.missing"), F.get_json_object("data", "$.k")).alias("nested"),
    )


@query("""select id, (['clear', 'light', 'medium', 'heavy'])[coalesce(smoke_rating, 0) + 1] as smoke,
(['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW', 'N'])[cast(round_even((stars * 10 % 360) / 22.5, 0) as int) + 1] as heading from frames""")
def code_labels(t):
    """the smoke word and the point of the compass, halves rounded to even."""
    from starledger.functions.sky import cardinal

    words = F.array(*[F.lit(x) for x in ("clear", "light", "medium", "heavy")])
    return t.frames.select("id", F.element_at(words, F.coalesce("smoke_rating", F.lit(0)) + 1).alias("smoke"), cardinal(F.col("stars") * 10 % 360).alias("heading"))


@query("select id, md5(id::varchar || ':' || filename) as key, sha256(filename) as sha from frames")
def hash_keys(t):
    """F30."""
    return t.frames.select("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), "filename")).alias("key"), F.sha2("filename", 256).alias("sha"))


@query("select conv_id, role, count(*) as turns from conversations group by conv_id, role")
def json_roles(t):
    """an array of objects in JSON, exploded and counted by role."""
    docs = t.conversations.select("conv_id", F.to_json(F.array(F.struct("role", "turn"))).alias("doc"))
    rows = docs.select("conv_id", F.explode(F.from_json("doc", "array<struct<role:string,turn:bigint>>")).alias("x"))
    return rows.groupBy("conv_id", F.col("x.role").alias("role")).agg(F.count("*").alias("turns"))
