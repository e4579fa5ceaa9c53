"""Windows, ordered state, sorts and top-k."""

from pyspark.sql import functions as F

from starledger.operators import ordering as op

from .registry import query


@query("""select id, camera_id, round(date_diff('microsecond', lag(create_date) over (partition by camera_id order by create_date, id), create_date) / 1e6, 6) as period, round(elapsed - exposure, 6) as delta from frames""")
def frame_lag(t):
    """W1."""
    return op.lags(t.frames).select("id", "camera_id", F.round("period", 6).alias("period"), F.round("delta", 6).alias("delta"))


@query("select id, create_date, camera_id from frames where create_date > timestamp '2024-01-20 00:00:00' - interval 3 hours and create_date <= timestamp '2024-01-20 00:00:00' order by create_date desc, id desc limit 50")
def newest_frames(t):
    """T1-T3."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return t.frames.where((F.col("create_date") > now - F.make_dt_interval(hours=F.lit(3))) & (F.col("create_date") <= now)).orderBy(F.desc("create_date"), F.desc("id")).limit(50).select("id", "create_date", "camera_id")


@query("""with r as (select *, sum(case when exclude then 1 else 0 end) over (partition by camera_id order by create_date, id rows unbounded preceding) as run from frames)
select id, run::bigint as run, case when count(adu) over w = 6 then round(avg(adu) over w, 6) end as mean from r window w as (partition by camera_id, run order by create_date, id rows 5 preceding)""")
def moving_avg_6(t):
    """An excluded frame resets the history."""
    return op.moving_average(t.frames, "adu", F.col("exclude")).select("id", "run", F.round("mean", 6).alias("mean"))


_CONTROL = """with recursive o as (select id, camera_id, case when adu > 0 then adu else 0.1 end as adu, row_number() over (partition by camera_id order by create_date, id) as n from frames),
r as (select distinct camera_id, 0::bigint as n, null::bigint as id, false as found, 0.0::double as level, []::double[] as history, 1.0::double as exposure from frames
union all select camera_id, n, id,
 case when found then not (len(kept) = 6 and abs(list_sum(kept) / 6 - level) > deviation) else abs(adu - 75.0) <= deviation end,
 case when not found and abs(adu - 75.0) <= deviation then adu else level end,
 case when found then kept when abs(adu - 75.0) <= deviation then []::double[] else history end,
 case when found or abs(adu - 75.0) <= deviation then exposure else least(60.0, greatest(1e-5, exposure - (exposure - exposure * (75.0 / adu)) * scale)) end
 from (select r.camera_id, o.n, o.id, o.adu::double as adu, r.found, r.level, r.history, r.exposure, case when r.exposure < 0.001 then 20.0 else 10.0 end as deviation, case when r.exposure < 0.001 then 0.5 else 1.0 end as scale,
  list_concat(r.history, [o.adu::double])[greatest(1, len(r.history) - 4):] as kept from r join o on o.camera_id = r.camera_id and o.n = r.n + 1) s)
select id, camera_id, found, round(exposure, 8) as exposure from r where id is not null"""


@query(_CONTROL)
def exposure_states(t):
    """Feedback, so no window expresses it, but a recursion does."""
    states = op.by_batches(t.frames.select("id", "camera_id", "create_date", "adu"), "camera_id", ["create_date", "id"], op.Exposure, "id bigint, camera_id int, found boolean, exposure double")
    return states.withColumn("exposure", F.round("exposure", 8))


@query("""with recursive o as (select id, camera_id, adu::double as v, row_number() over (partition by camera_id order by create_date, id) as k from frames),
r as (select distinct camera_id, 0::bigint as k, null::bigint as id, false as taken, 0::bigint as n, 0.0::double as mean, 0.0::double as m2 from frames
union all select camera_id, k, id, ok, case when ok then n + 1 else n end, case when ok then mean + (v - mean) / (n + 1) else mean end, case when ok then m2 + (v - mean) * (v - (mean + (v - mean) / (n + 1))) else m2 end
 from (select r.camera_id, o.k, o.id, o.v, r.n, r.mean, r.m2, r.n < 15 or abs(o.v - r.mean) <= 3.0 * sqrt(r.m2 / r.n) as ok from r join o on o.camera_id = r.camera_id and o.k = r.k + 1) s)
select id, camera_id, taken from r where id is not null""")
def rotation_gate(t):
    """Feedback, checked by a recursion."""
    return op.by_batches(t.frames.select("id", "camera_id", "create_date", "adu"), "camera_id", ["create_date", "id"], op.Gate, "id bigint, camera_id int, taken boolean")


@query("select id, name from cameras order by daytime_save desc, connect_date desc, id limit 1")
def current_camera(t):
    """W6, T2."""
    return t.cameras.orderBy(F.desc("daytime_save"), F.desc("connect_date"), "id").limit(1).select("id", "name")


_CHANGES = """with x as (select id, camera_id, create_date, night, lag(night) over (partition by camera_id order by create_date, id) as was from frames),
c as (select id, camera_id, create_date, night, row_number() over (partition by camera_id order by create_date, id)::int as session from x where was is null or was <> night)"""


@query(f"{_CHANGES} select * from c")
def transitions(t):
    """W7, Q5."""
    return op.transitions(t.frames.select("id", "camera_id", "create_date", "night"), "night")


@query(f"{_CHANGES} select *, lead(create_date) over (partition by camera_id order by create_date, id) as ends from c")
def transition_ends(t):
    """Q5: when each session of night or day ended, from the frames themselves."""
    return op.next_transition(op.transitions(t.frames.select("id", "camera_id", "create_date", "night"), "night"))


@query("select id, camera_id, row_number() over (partition by camera_id order by create_date, id)::int - 11 as col from frames qualify row_number() over (partition by camera_id order by create_date, id) > 10")
def keogram_columns(t):
    """The frame's column in the keogram after ten skipped frames."""
    numbered = op.placed(t.frames.select("id", "camera_id", "create_date"), ["camera_id"], [F.to_date("create_date")], [F.col("create_date"), F.col("id")])
    return numbered.where("at > 10").select("id", "camera_id", (F.col("at") - 11).cast("int").alias("col"))


@query("select id, camera_id, max(adu) over w as max_so_far, arg_min(id, (adu, id)) over w as darkest_so_far from frames window w as (partition by camera_id order by create_date, id rows unbounded preceding)")
def running_max(t):
    """W10, W11."""
    return op.running(t.frames)


@query("""select camera_id, date_diff('second', date_trunc('second', max(create_date)), timestamp '2024-01-31 00:00:00') as age,
case when date_diff('second', date_trunc('second', max(create_date)), timestamp '2024-01-31 00:00:00') > 5000 then 'DOWN' else 'UP' end as status from frames group by camera_id""")
def watchdog(t):
    """W12, W13."""
    last = t.frames.groupBy("camera_id").agg(F.max("create_date").alias("last"))
    return op.age(last, "last", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 5000).select("camera_id", "age", "status")


@query("select camera_id, id, adu, place::int as place from (select *, row_number() over (partition by camera_id order by adu desc, id) as place from frames) where place <= 10")
def top_k_per_group(t):
    """T6."""
    return op.top_k(t.frames.select("camera_id", "id", "adu"), ["camera_id"], [F.desc("adu"), F.col("id")], 10)


@query("select id, stratum, place::int as place from (select id, stars % 8 as stratum, row_number() over (partition by stars % 8 order by adu desc, id) as place from frames) order by place, stratum limit 500")
def stratified_top_k(t):
    """500 stars over eight rings."""
    return op.stratified(t.frames, F.col("stars") % 8, [F.desc("adu"), F.col("id")], 500).select("id", "stratum", "place")


@query("select id, place::int as place from (select id, row_number() over (partition by camera_id order by priority asc nulls first, create_date asc, id) as place from videos)")
def priority_queue(t):
    """A missing priority comes first; the queue of each camera is its own."""
    queue = t.videos.select("id", "camera_id", "create_date", F.coalesce("priority", F.lit(-1)).alias("priority"))
    placed = op.placed(queue, ["camera_id"], [F.col("priority"), F.to_date("create_date")], [F.col("create_date"), F.col("id")], "place")
    return placed.select("id", F.col("place").cast("int").alias("place"))


@query("select camera_id, day_date, night, count(*) as n, count(*) = 1 as one from videos group by all")
def exactly_one(t):
    """T9."""
    return op.exactly_one(t.videos, ["camera_id", "day_date", "night"])


@query("select day_date, count(*) as n, cast(sum(case when night then 1 else 0 end) as bigint) as nights from frames group by day_date order by day_date")
def paging_free_listing(t):
    """T4: the pages of an unordered listing are one aggregation."""
    return t.frames.groupBy("day_date").agg(F.count("*").alias("n"), F.count_if("night").alias("nights")).orderBy("day_date")
