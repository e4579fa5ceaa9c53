"""Set operations and changes to tables."""

from pyspark.sql import functions as F

from starledger.operators import dml as op

from .registry import query


@query("select 'image' as kind, camera_id, count(*) as n from frames group by camera_id union all select 'video', camera_id, count(*) from videos group by camera_id union all select 'thumbnail', camera_id, count(*) from thumbnails group by camera_id")
def union_assets(t):
    """U1."""
    return op.union_tagged({"image": t.frames.select("camera_id"), "video": t.videos.select("camera_id"), "thumbnail": t.thumbnails.select("camera_id")}).groupBy("kind", "camera_id").agg(F.count("*").alias("n"))


@query("""with o as (select c_custkey as k, c_acctbal as v, 0 as n, 0 as i from customer), w as (select user_id * 7 as k, value as v, 1 as n, event_id as i from events)
select k, arg_max(v, (n, i)) as v from (select * from o union all select * from w) group by k""")
def upsert_latest(t):
    """U2."""
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("bigint").alias("i"))
    new = t.events.select((F.col("user_id") * 7).alias("k"), F.col("value").alias("v"), F.col("event_id").alias("i"))
    return op.upsert(old, new, ["k"], ["i"]).select("k", "v")


@query("select p_brand as grp, p_partkey as id from part where p_brand not in ('Brand#1', 'Brand#2') union all select 'Brand#1', s_suppkey from supplier")
def replace_group(t):
    """The whole group goes, also where the new one is smaller."""
    new = t.supplier.select(F.lit("Brand#1").alias("grp"), F.col("s_suppkey").alias("id"))
    return op.replace_groups(t.part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id")).where("grp <> 'Brand#2'"), new, "grp")


@query("""select a.id, case when exists (select 1 from videos v where v.camera_id = a.camera_id and v.day_date = a.day_date and v.night = a.night)
 or row_number() over (partition by camera_id, day_date, night order by id) > 1 then 'rejected' else 'inserted' end as outcome from assets a where kind = 'keogram'""")
def insert_or_reject(t):
    """U4, K6."""
    by = ["camera_id", "day_date", "night"]
    return op.insert_or_reject(t.videos, t.assets.where("kind = 'keogram'").select("id", *by), by, "id", overwrite=False).select("id", "outcome")


@query("select id, event_type from frames where not (create_date < timestamp '2024-01-31 00:00:00' - interval 3 days)")
def delete_old_tasks(t):
    """U5, T5."""
    return op.without(t.frames, F.col("create_date") < F.lit("2024-01-31").cast("timestamp_ntz") - F.make_dt_interval(F.lit(3))).select("id", "event_type")


@query("select id, case when event_type in ('view', 'click') then 'EXPIRED' else event_type end as state from frames")
def state_expire(t):
    """U6."""
    return op.rewrite(t.frames.select("id", F.col("event_type").alias("state")), "state", F.col("state").isin("view", "click"), F.lit("EXPIRED"))


@query("select id, case when camera_id = 3 then 1 else camera_id end as camera_id from frames")
def merge_cameras(t):
    """U7."""
    return op.rewrite(t.frames.select("id", "camera_id"), "camera_id", F.col("camera_id") == 3, F.lit(1))


_SHOWN = """select id from (with recursive n as (select id, camera_id, event_type, floor(epoch(create_date))::bigint as t from frames),
shown as (select camera_id, event_type, min(t) as t from n group by all union all
          select s.camera_id, s.event_type, min(n.t) from shown s join n on n.camera_id = s.camera_id and n.event_type = s.event_type and n.t >= s.t + 43200 group by s.camera_id, s.event_type)
select min(n.id) as id from shown s join n using (camera_id, event_type, t) group by camera_id, event_type, t)"""


@query(_SHOWN)
def notification_dedup(t):
    """U8, Q8: a note of a camera and category is shown once in twelve hours."""
    notes = t.frames.select("id", "camera_id", "event_type", F.unix_timestamp(F.col("create_date").cast("timestamp")).alias("t"))
    return op.suppressed(notes, ["camera_id", "event_type"], "t", 43200)


@query("select uuid from thumbnails where uuid not in (select thumbnail_uuid from frames where thumbnail_uuid is not null and camera_id = 1) or uuid in (select thumbnail_uuid from frames where thumbnail_uuid is not null and camera_id <> 1)")
def cascade_delete(t):
    """U9."""
    return op.cascade(t.frames.where("thumbnail_uuid is not null"), F.col("camera_id") == 1, t.thumbnails.select("uuid"), "thumbnail_uuid", "uuid")


@query("select id, coalesce(day_year, cast(year(create_date) as int)) as day_year, coalesce(day_month, cast(month(create_date) as int)) as day_month from videos")
def backfill_parts(t):
    """U10."""
    return op.fill_missing(t.videos, {"day_year": F.year("create_date"), "day_month": F.month("create_date")}).select("id", "day_year", "day_month")
