"""Streams run to the end of their input (Q1-Q12)."""

from pyspark.sql import functions as F

from starledger.streaming import live as op

from .ordering import _CONTROL
from .registry import query
from .tables_dml import _SHOWN


def _frames(t):
    return op.frames(t.spark, t.sf_dir)


def _plain(df, *columns):
    """Timestamps as the stored tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("select camera_id, day_date, night, count(*) as frames, max(stars) as max_stars, round(avg(sqm), 6) as avg_sqm from frames where not exclude group by all")
def stream_night_rollup(t):
    """Q1: each batch's part of the nights, added up."""
    return op.nights(op.in_batches(_frames(t), op.night_parts)).withColumn("avg_sqm", F.round("avg_sqm", 6))


_END = "(select date_trunc('millisecond', max(create_date)) - interval 10 minutes from frames)"


@query(f"select camera_id, start, n, round(adu, 6) as adu, round(sqm, 6) as sqm from (select camera_id, time_bucket(interval '15 minutes', create_date) as start, count(*) as n, avg(adu) as adu, avg(sqm) as sqm from frames group by all) where start + interval 15 minutes <= {_END}")
def stream_15min(t):
    """Q2: the windows that the watermark has closed."""
    return _plain(op.drained(op.tumbling(_frames(t), 15, "10 minutes", ["adu", "sqm"])), "start").select("camera_id", "start", "n", F.round("adu", 6).alias("adu"), F.round("sqm", 6).alias("sqm"))


@query(f"select camera_id, start, count(*) as n, round(avg(stars), 6) as stars from (select camera_id, stars, time_bucket(interval '10 minutes', create_date) - interval 10 minutes * k as start from frames, range(3) s(k)) where start + interval 30 minutes <= {_END} group by all")
def stream_sliding(t):
    """Q3: half an hour, every ten minutes."""
    return _plain(op.drained(op.sliding(_frames(t), 30, 10, "10 minutes", ["stars"])), "start").select("camera_id", "start", "n", F.round("stars", 6).alias("stars"))


@query("select id from frames where create_date > timestamp '2024-01-20 00:00:00' - interval 4 hours and create_date <= timestamp '2024-01-20 00:00:00'")
def stream_history(t):
    """Q4: the history that a chart shows."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return op.drained(_frames(t).where((F.col("create_date") > now - F.make_dt_interval(hours=F.lit(4))) & (F.col("create_date") <= now)).select("id"))


@query(f"""with g as (select camera_id, create_date, case when create_date - lag(create_date) over w <= interval 45 minutes then 0 else 1 end as opens from frames window w as (partition by camera_id order by create_date)),
s as (select *, sum(opens) over (partition by camera_id order by create_date) as s from g)
select camera_id, start, "end", n from (select camera_id, s, min(create_date) as start, max(create_date) + interval 45 minutes as "end", count(*) as n from s group by all) where "end" <= {_END}""")
def stream_sessions(t):
    """Q5."""
    return _plain(op.drained(op.sessions(_frames(t), "45 minutes", "10 minutes")), "start", "end")


_BUFFER = "select camera_id, list(id order by create_date, id) as ids from (select * from frames qualify row_number() over (partition by camera_id order by create_date desc, id desc) <= 1000) group by camera_id"


@query(_BUFFER)
def stream_buffer(t):
    """The last thousand columns, as the last batch leaves them."""
    return op.newest_state(op.drained(op.last_columns(_frames(t), 1000)))


query(_BUFFER, name="stream_buffer_1000")(stream_buffer)


@query(_CONTROL)
def stream_exposures(t):
    """Q7: the same states as the batch form's."""
    return op.drained(op.exposures(_frames(t))).withColumn("exposure", F.round("exposure", 8))


@query(_SHOWN)
def stream_notifications(t):
    """Q8: the same notes as the batch form's."""
    return op.drained(op.notifications(_frames(t), 43200))


@query("select id from frames where stars <= 60")
def stream_fresh(t):
    """Q9: the sender's clock is ``stars`` seconds off."""
    late = _frames(t).withColumn("received", F.col("create_date") + F.make_dt_interval(secs=F.col("stars").cast("decimal(18,6)")))
    return op.drained(op.fresh(late, 60).select("id"))


@query("select id from frames where create_date > timestamp '2024-01-29 00:00:00'")
def clock_skew(t):
    """Q10."""
    return op.skewed_clocks(t.frames, F.lit("2024-01-29").cast("timestamp_ntz")).select("id")


@query("select count(*) as n from (select distinct camera_id, stars, day_date from frames)")
def stream_dedup(t):
    """Q11: a command that is repeated within the delay is taken once."""
    return op.drained(op.without_repeats(_frames(t), ["camera_id", "stars", "day_date"], "40 days").select("id")).agg(F.count("*").alias("n"))


@query("""with s as (select * from (values ('aurora', 3600), ('smoke', 10800), ('elements', 86400), ('backup', 604800)) v(source, period)), l as (select camera_id, max(create_date) as last from frames group by camera_id)
select camera_id, source, last + to_seconds(period) as due, timestamp '2024-01-31 00:00:00' >= last + to_seconds(period) as refresh from l, s""")
def refresh_timers(t):
    """Q12: when each source of a camera is to be fetched again, and whether it is time."""
    last = t.frames.groupBy("camera_id").agg(F.max("create_date").alias("last"))
    return op.due(last, {"aurora": 3600, "smoke": 10800, "elements": 86400, "backup": 604800}, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("camera_id", "source", "due", "refresh")
