"""Aggregations."""

from pyspark.sql import functions as F

from starledger.operators import rollups as op

from .registry import query

AS_OF = "2024-01-20 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _trailing(column):
    return f"""select camera_id, max({column}) as max_{column}, min({column}) as min_{column}, round(avg({column}), 6) as avg_{column} from frames
where create_date > timestamp '{AS_OF}' - interval 600 minutes and create_date <= timestamp '{AS_OF}' group by camera_id"""


@query(_trailing("sqm"))
def trailing_window_stats(t):
    """A1: ten hours here, as the fixture has a frame each few minutes."""
    return _rounded(op.trailing_stats(t.frames, "sqm", _as_of(), 600), "avg_sqm")


@query(_trailing("stars"))
def trailing_star_stats(t):
    """A2."""
    return _rounded(op.trailing_stats(t.frames, "stars", _as_of(), 600), "avg_stars")


_NIGHT = "select camera_id, day_date, night, count(*) as frames, max(kpindex) as max_kpindex, max(ovation_max) as max_ovation_max, max(smoke_rating) as max_smoke_rating, max(stars) as max_stars, round(avg(stars), 6) as avg_stars, max(moonphase) as max_moonphase, round(avg(sqm), 6) as avg_sqm from frames where not exclude group by all"


@query(_NIGHT)
def night_rollup(t):
    """A3, J1."""
    return _rounded(op.night_rollup(t.frames), "avg_stars", "avg_sqm")


@query(f"""with n as ({_NIGHT}) select camera_id, day_date, night, case when ok then max_kpindex else 0.0 end as max_kpindex, case when ok then max_ovation_max else 0 end as max_ovation_max,
case when ok then max_smoke_rating else -1 end as max_smoke_rating, case when ok then max_stars else 0 end as max_stars, case when ok then avg_stars else 0.0 end as avg_stars,
case when ok then max_moonphase else -1.0 end as max_moonphase, case when ok then avg_sqm else 0.0 end as avg_sqm
from (select *, max_kpindex is not null and max_smoke_rating is not null as ok from n)""")
def night_rollup_defaults(t):
    """A3, P19."""
    return _rounded(op.night_rollup_defaults(t.frames), "avg_stars", "avg_sqm")


@query("""select day_date, count(*) filter (kind = 'image' and not night) as image_day, count(*) filter (kind = 'image' and night) as image_night,
count(*) filter (kind = 'panorama' and not night) as panorama_day, count(*) filter (kind = 'panorama' and night) as panorama_night
from (select day_date, night, 'image' as kind from frames union all select day_date, night, 'panorama' from assets where kind = 'panoramaimage') group by day_date""")
def day_night_counts(t):
    """A4."""
    return op.paired_counts({"image": t.frames, "panorama": t.assets.where("kind = 'panoramaimage'")})


@query("select cast(floor(epoch / 3600) as bigint) as bucket, round(avg(adu), 6) as adu, round(avg(sqm), 6) as sqm, round(avg(stars), 6) as stars from (select *, floor(epoch(create_date))::bigint as epoch from frames) group by 1")
def epoch_bucket_avg(t):
    """A5."""
    rows = t.frames.withColumn("epoch", F.unix_timestamp(F.col("create_date").cast("timestamp")))
    return _rounded(op.epoch_buckets(rows, "epoch", 3600, ["adu", "sqm", "stars"]), "adu", "sqm", "stars")


def _drill(parts):
    names = {"y": "year", "m": "month", "d": "day", "h": "hour"}
    return f"select distinct {', '.join(f'cast({names[p]}(create_date) as int) as {p}' for p in parts)} from frames where camera_id = 1 and not exclude"


def _parts(names):
    made = {"y": F.year("create_date"), "m": F.month("create_date"), "d": F.dayofmonth("create_date"), "h": F.hour("create_date")}
    return {n: made[n] for n in names}


for _name, _which in (("drill_years", "y"), ("drill_months", "ym"), ("drill_days", "ymd"), ("drill_hours", "ymdh")):
    query(_drill(_which), name=_name)(lambda t, w=_which: op.drill_down(t.frames, _parts(w), F.col("camera_id") == 1, ~F.col("exclude")))


@query("select distinct coalesce(day_year, cast(year(day_date) as int)) as y, coalesce(day_month, cast(month(day_date) as int)) as m from videos where camera_id = 2")
def drill_video_months(t):
    """A7."""
    return op.drill_down(t.videos, {"y": F.coalesce("day_year", F.year("day_date")), "m": F.coalesce("day_month", F.month("day_date"))}, F.col("camera_id") == 2)


@query("select cast(year(create_date) as int) as y, cast(month(create_date) as int) as m, cast(day(create_date) as int) as d, cast(hour(create_date) as int) as h, count(*) as n from frames group by all")
def hourly_groups(t):
    """A8, A9."""
    return t.frames.groupBy(*[c.alias(n) for n, c in _parts("ymdh").items()]).agg(F.count("*").alias("n"))


@query("select camera_id, count(*) as n from frames where not exclude and night group by camera_id")
def filtered_count(t):
    """A9."""
    return t.frames.where("not exclude and night").groupBy("camera_id").agg(F.count("*").alias("n"))


@query("""select kind, count(*) as n_rows, count(*) filter (remote) as remote_done, count(*) filter (not remote) as remote_missing, count(*) filter (uploaded) as uploaded_done, count(*) filter (not uploaded) as uploaded_missing from
(select 'image' as kind, remote_url is not null as remote, null::boolean as uploaded from frames union all select 'video', null, uploaded from videos union all select kind, null, uploaded from assets) group by kind""")
def upload_matrix(t):
    """A10, U1."""
    kinds = ["keogram", "startrail", "startrailvideo", "panoramavideo", "fitsimage", "rawimage", "panoramaimage"]
    assets = t.assets
    tables = {"image": t.frames.withColumn("remote", F.col("remote_url").isNotNull()), "video": t.videos}
    parts = op.upload_matrix(tables, ["remote", "uploaded"])
    # the asset tables are one table with a kind: one pass gives all of them
    flags = assets.groupBy("kind").agg(F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("remote_done"), F.lit(0).cast("bigint").alias("remote_missing"), F.count_if("uploaded").alias("uploaded_done"), F.count_if(~F.col("uploaded")).alias("uploaded_missing"))
    return parts.unionByName(flags.where(F.col("kind").isin(*kinds)))


_KINDS = ["keogram", "fitsimage"]


@query(f"""select day_date, night, cast(sum(file_size) as bigint) as total_bytes, {', '.join(f"cast(sum(file_size) filter (kind = '{k}') as bigint) as {k}_bytes, count(*) filter (kind = '{k}') as {k}_files" for k in _KINDS)},
cast(grouping(day_date) * 2 + grouping(night) as bigint) as level from assets group by rollup (day_date, night) having grouping(day_date) * 2 + grouping(night) < 3""")
def usage_rollup(t):
    """A11; the shape of the missing view is inferred from its table's columns."""
    return op.usage(t.assets, _KINDS)


@query("select day_date, cast(sum(file_size) filter (kind = 'keogram') as bigint) as keogram, cast(sum(file_size) filter (kind = 'fitsimage') as bigint) as fitsimage from assets where kind in ('keogram', 'fitsimage') group by day_date")
def usage_pivot(t):
    """A11."""
    return t.assets.where(F.col("kind").isin(*_KINDS)).groupBy("day_date").pivot("kind", _KINDS).agg(F.sum("file_size"))


_BUCKETS = "select camera_id, time_bucket(interval '15 minutes', create_date) as start, count(*) as n, avg(exposure) as exposure, avg(adu) as adu, avg(sqm) as sqm, avg(stars) as stars from frames group by all"


@query(f"select camera_id, start, n, round(exposure, 6) as exposure, round(adu, 6) as adu, round(sqm, 6) as sqm, round(stars, 6) as stars from ({_BUCKETS})")
def adu_15min(t):
    """A12."""
    return _rounded(op.bucket_means(t.frames, 15, ["exposure", "adu", "sqm", "stars"]), "exposure", "adu", "sqm", "stars")


@query(f"select camera_id, round(avg(adu), 6) as adu, round(avg(sqm), 6) as sqm from ({_BUCKETS}) group by camera_id")
def mean_of_bucket_means(t):
    """A13."""
    return _rounded(op.mean_of_bucket_means(op.bucket_means(t.frames, 15, ["adu", "sqm"]), ["adu", "sqm"]), "adu", "sqm")


@query("select camera_id, arg_max(sqm, (create_date, id)) as sqm, max(create_date) as create_date from frames group by camera_id")
def latest_per_camera(t):
    """A14, W5."""
    return op.latest(t.frames, ["camera_id"], ["create_date", "id"], ["sqm", "create_date"])


@query("select count(*) as n, round(avg(bt), 6) as bt, round(avg(temperature), 6) as temperature from (select create_date as ts, case when stars % 9 = 0 then null else adu end as bt, trunc(sqm * 1000.7) as temperature, event_type as source from frames) where ts > timestamp '2024-01-20 00:00:00' - interval 1200 minutes and ts <= timestamp '2024-01-20 00:00:00' and source = 'view' and bt is not null")
def solar_wind_means(t):
    """Temperatures are cut to whole numbers before the mean."""
    feed = t.frames.select(F.col("create_date").alias("ts"), F.when(F.col("stars") % 9 != 0, F.col("adu")).alias("bt"), (F.col("sqm") * 1000.7).cast("bigint").cast("double").alias("temperature"), F.col("event_type").alias("source"))
    return _rounded(op.recent_means(feed, _as_of(), 1200, ["bt", "temperature"], "view"), "bt", "temperature")


@query("select camera_id, max(ovation_max) as max_cell, round(avg(ovation_max), 6) as mean_cell from frames where stars between 40 and 60 group by camera_id")
def ovation_cells(t):
    """A16."""
    return _rounded(t.frames.where("stars between 40 and 60").groupBy("camera_id").agg(F.max("ovation_max").alias("max_cell"), F.avg("ovation_max").alias("mean_cell")), "mean_cell")


@query("select camera_id, day_date, case when count(*) > 1 then round(regr_slope(kpindex, i), 6) + 0.0 end as slope, case when count(*) > 1 then round(regr_intercept(kpindex, i), 6) + 0.0 end as intercept, arg_max(kpindex, i) as last from (select *, row_number() over (partition by camera_id, day_date order by create_date, id) - 1 as i from frames where kpindex is not null) group by all")
def kp_regression(t):
    """Both coefficients under their own names; null where a group has a single row."""
    fitted = _rounded(op.index_regression(t.frames.where("kpindex is not null"), ["camera_id", "day_date"], ["create_date", "id"], "kpindex"), "slope", "intercept")
    return fitted.withColumns({c: F.col(c) + F.lit(0.0) for c in ("slope", "intercept")})  # no negative zero


@query("select camera_id, arg_max(adu, id) as power from frames where event_type = 'view' group by camera_id")
def last_matching_line(t):
    """A18."""
    return t.frames.where("event_type = 'view'").groupBy("camera_id").agg(F.max_by("adu", "id").alias("power"))


@query("""with q as (select camera_id, quantile_cont(adu, 0.5) as median, quantile_cont(adu, 0.1) as lo, quantile_cont(adu, 0.9) as hi from frames group by camera_id)
select camera_id, round(median, 6) as median, round(mad(adu), 6) as mad, round(quantile_cont(adu, 0.5) filter (adu between lo and hi), 6) as trimmed_median, round(mad(adu) / abs(median), 6) as relative_mad from frames join q using (camera_id) group by camera_id, median""")
def robust_stats(t):
    """A19."""
    return _rounded(op.robust(t.frames, ["camera_id"], "adu").select("camera_id", "median", "mad", "trimmed_median", "relative_mad"), "median", "mad", "trimmed_median", "relative_mad")


@query("""select metric, good_min, good_max, bad_min, bad_max, good_max < bad_min as parted, case when good_max < bad_min then (good_max + bad_min) / 2 end as midpoint from (
select 'adu' as metric, min(adu) filter (not exclude) as good_min, max(adu) filter (not exclude) as good_max, min(adu) filter (exclude) as bad_min, max(adu) filter (exclude) as bad_max from frames
union all select 'flag', min(flag) filter (not exclude), max(flag) filter (not exclude), min(flag) filter (exclude), max(flag) filter (exclude) from (select exclude, sqm + case when exclude then 100 else 0 end as flag from frames))""")
def class_ranges(t):
    """A20, X8."""
    rows = t.frames.withColumn("flag", F.col("sqm") + F.when(F.col("exclude"), 100).otherwise(0))
    return op.class_ranges(rows, "exclude", ["adu", "flag"])


@query()
def two_means(t):
    """Iterative, held against numpy in the tests."""
    low, high = op.two_means(t.frames.where("adu > 0").select("adu", "sqm"), ["adu", "sqm"])
    return t.spark.createDataFrame([("low", low["adu"], low["sqm"]), ("high", high["adu"], high["sqm"])], "centre string, adu double, sqm double")


@query("""select camera_id, case when exclude then 'excluded' when not night then 'day' when adu > 100 then 'adu' when stars < 10 then 'stars' when moonphase > 80 then 'moon' else 'used' end as reason, count(*) as n from frames group by all""")
def exclusion_reasons(t):
    """A22, N28's gates: the first that fails names the reason."""
    gates = [("excluded", F.col("exclude")), ("day", ~F.col("night")), ("adu", F.col("adu") > 100), ("stars", F.col("stars") < 10), ("moon", F.col("moonphase") > 80)]
    return t.frames.groupBy("camera_id", op.reasons(t.frames, gates).alias("reason")).agg(F.count("*").alias("n"))


@query("select (select count(*) from cameras where not hidden) as cameras, (select count(distinct camera_id) from frames) as seen")
def camera_counts(t):
    """A24."""
    seen = t.frames.agg(F.lit(0).cast("bigint").alias("cameras"), F.count_distinct("camera_id").alias("seen"))
    return t.cameras.where("not hidden").agg(F.count("*").alias("cameras"), F.lit(0).cast("bigint").alias("seen")).union(seen).agg(F.sum("cameras").alias("cameras"), F.sum("seen").alias("seen"))
