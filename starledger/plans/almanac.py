"""Sun, moon and the days of a site."""

from pyspark.sql import functions as F

from starledger.functions import ephemeris as eph
from starledger.functions import sky
from starledger.operators import almanac as op

from .registry import query

# SQL of the same series: expressions of a column that holds UTC epoch seconds


def _days(t):
    return f"(({t} - 946728000.0::double) / 86400.0)"


def _wrap(x, turn=360.0):
    return f"((({x}) % {turn}) + {turn}) % {turn}"


def _gmst(t):
    n = _days(t)
    c = f"({n} / 36525.0)"
    return _wrap(f"280.46061837 + 360.98564736629 * {n} + 0.000387933 * {c} * {c} - {c} * {c} * {c} / 38710000.0")


def _sun_lon(t):
    n = _days(t)
    g = f"radians(357.528 + 0.9856003 * {n})"
    return f"(280.460 + 0.9856474 * {n} + 1.915 * sin({g}) + 0.020 * sin(2 * {g}))"


def _sun(t):
    tilt, a = f"radians(23.439 - 0.0000004 * {_days(t)})", f"radians({_sun_lon(t)})"
    return {"ra": f"degrees(atan2(cos({tilt}) * sin({a}), cos({a})))", "dec": f"degrees(asin(sin({tilt}) * sin({a})))"}


def _sum(terms, t, wave):
    c = f"({_days(t)} / 36525.0)"
    angles = [f"({start} + {growth} * {c})" for start, growth in eph.MOON_ANGLES[1:]]
    return " + ".join(f"({size}) * {wave}(radians({' + '.join(f'({k}) * {a}' for k, a in zip(ks, angles, strict=True) if k)}))" for size, ks in terms)


def _moon_lon(t):
    start, growth = eph.MOON_ANGLES[0]
    return f"({start} + {growth} * ({_days(t)} / 36525.0) + {_sum(eph.MOON_LONGITUDE, t, 'sin')})"


def _moon(t):
    a, b, tilt = f"radians({_moon_lon(t)})", f"radians({_sum(eph.MOON_LATITUDE, t, 'sin')})", f"radians(23.439 - 0.0000004 * {_days(t)})"
    return {
        "ra": f"degrees(atan2(sin({a}) * cos({tilt}) - tan({b}) * sin({tilt}), cos({a})))",
        "dec": f"degrees(asin(sin({b}) * cos({tilt}) + cos({b}) * sin({tilt}) * sin({a})))",
        "distance": f"(385000.56 + {_sum(eph.MOON_DISTANCE, t, 'cos')})",
    }


_BODIES, _PACE = {"sun": _sun, "moon": _moon}, {"sun": "240.0", "moon": "248.41"}


def _alt(body, t, lat="latitude", lon="longitude"):
    at = _BODIES[body](t)
    d, p = f"radians({at['dec']})", f"radians({lat})"
    up = f"asin(least(1.0, greatest(-1.0, sin({p}) * sin({d}) + cos({p}) * cos({d}) * cos(radians({_gmst(t)} + {lon} - ({at['ra']}))))))"
    if body == "moon":
        # the outer select of a lateral pair, so that the long expression stands once
        return f"(select degrees(h - asin(6378.14 / {at['distance']}) * cos(h)) from (select {up} as h))"
    return f"degrees({up})"


def _hour(body, t, off="0.0"):
    """Degrees past the meridian (or past ``off`` degrees from it), from -180 to 180."""
    turned = f"({_wrap(f'{_gmst(t)} + longitude - ({_BODIES[body](t)["ra"]}) + 180.0')} - 180.0)"
    return f"({_wrap(f'{turned} - {off} + 180.0')} - 180.0)"


def _settled(source, column, body, off="0.0"):
    """``source`` with five steps towards the transit nearest to ``column``."""
    for _ in range(5):
        source = f"(select * replace ({column} - {_hour(body, column, off)} * {_PACE[body]} as {column}) from {source})"
    return source


_SITE = "(select id as camera_id, latitude, longitude, utc_offset from cameras)"
_AT_SITE = f"(select f.*, latitude, longitude, utc_offset, epoch(create_date) - utc_offset as utc, cast(create_date as date) as day from frames f join {_SITE} using (camera_id))"


def _site_days(body):
    half, pace = float(180 * float(_PACE[body])), _PACE[body]
    days = f"(select *, epoch(day) - utc_offset as start from (select distinct camera_id, cast(create_date as date) as day from frames) join {_SITE} using (camera_id))"
    to_come = _wrap(f"-({_hour(body, 'start')})")
    noon = _settled(f"(select *, start + {to_come} * {pace} as noon from {days})", "noon", body)
    before = _settled(f'(select *, noon - {half} as "before" from {noon})', '"before"', body, "180.0")
    return _settled(f'(select *, noon + {half} as "after" from {before})', '"after"', body, "180.0")


def _events(days, body, horizons, steps=op.HALVINGS):
    """WITH clause: ``e`` has every event with the time found by halving, null where there is none."""
    spans = " union all ".join(
        f"select camera_id, day, latitude, longitude, '{name}' as event, {rises} as rises, {since} as since, {until} as until, {h}::double as horizon from d" for name, h in horizons.items() for rises, since, until in (("true", '"before"', "noon"), ("false", "noon", '"after"'))
    )
    above = lambda t: f"({_alt(body, t)} >= horizon)"
    return f"""with recursive d as materialized (select * from {days}), s as materialized ({spans}),
b as (select *, since as t, 0 as k from s union all
 select camera_id, day, latitude, longitude, event, rises, since, until, horizon, case when {above('x')} <> rises then x else t end, k + 1 from (select *, t + (until - since) / pow(2.0, k + 1) as x from b where k < {steps})),
e as (select camera_id, day, event, rises, case when {above('since')} <> rises and {above('until')} = rises then t end as moment from b where k = {steps})"""


def _whole(*names):
    return [F.round(n).cast("bigint").alias(n) for n in names]


@query(f'select camera_id, day, round(start)::bigint as start, round(noon)::bigint as noon, round("before")::bigint as "before", round("after")::bigint as "after" from {_site_days("sun")}')
def sun_days(t):
    """the sun's transits around each camera's local days, UTC epoch seconds."""
    return op.site_days(t.frames, t.cameras).select("camera_id", "day", *_whole("start", "noon", "before", "after"))


@query(f'select camera_id, day, round(noon)::bigint as noon, round("before")::bigint as "before", round("after")::bigint as "after" from {_site_days("moon")}')
def moon_days(t):
    """the moon's transits."""
    return op.site_days(t.frames, t.cameras, "moon").select("camera_id", "day", *_whole("noon", "before", "after"))


@query(f"{_events(_site_days('sun'), 'sun', op.TWILIGHTS)} select camera_id, day, event, rises, round(moment)::bigint as moment from e")
def sun_events(t):
    """Rise, set and the three twilights of each camera's days."""
    return op.events(op.site_days(t.frames, t.cameras), "sun", op.TWILIGHTS).select("camera_id", "day", "event", "rises", *_whole("moment"))


@query(f"{_events(_site_days('moon'), 'moon', {'horizon': 0.0})} select camera_id, day, rises, round(moment / 10)::bigint as moment from e")
def moon_events(t):
    """moonrise and moonset, to ten seconds."""
    found = op.events(op.site_days(t.frames, t.cameras, "moon"), "moon", {"horizon": 0.0})
    return found.select("camera_id", "day", "rises", F.round(F.col("moment") / 10).cast("bigint").alias("moment"))


_DAYS = f"(select f.*, {_alt('sun', 'utc')} as sun_alt, {_alt('sun', 'utc')} < -6.0 as dark, noon, \"before\", \"after\" from {_AT_SITE} f join (select camera_id, day, noon, \"before\", \"after\" from {_site_days('sun')}) using (camera_id, day))"


@query(f"""select id, dark as night, cast(case when utc < "before" then day - 1 when utc < noon then case when dark then day - 1 else day end when utc < "after" then day when dark then day else day + 1 end as date) as day_date,
cast(create_date - interval 12 hours as date) as by_clock from {_DAYS}""")
def day_dates(t):
    """by the sun's transits at the frame's camera, and by the clock, which is an approximation."""
    rows = op.with_day(t.frames, t.cameras)
    at = op.day_of(F.col("utc"), F.col("day"), F.col("dark"), F.col("before"), F.col("noon"), F.col("after"))
    return rows.select("id", F.col("dark").alias("night"), at.alias("day_date"), sky.day_date_by_clock(F.col("create_date")).alias("by_clock"))


_LATER = _settled(f'(select *, "after" + 86400.0 as after_2 from {_settled(f"(select *, noon + 86400.0 as noon_2 from {_DAYS})", "noon_2", "sun")})', "after_2", "sun", "180.0")


@query(f"""select id, dark as night, round(least(case when utc < "before" then noon when utc < noon then case when dark then noon else noon_2 end else noon_2 end,
case when utc < "before" then case when dark then "after" else "before" end when utc < noon then "after" when utc < "after" then case when dark then after_2 else "after" end else after_2 end))::bigint as stop from {_LATER}""")
def next_transition(t):
    """When the running night or day is over and its jobs may run, from the sun's transits."""
    return op.next_stop(op.with_day(t.frames, t.cameras)).select("id", F.col("dark").alias("night"), *_whole("stop"))


_TURNS = _settled("(select camera_id, day, latitude, longitude, noon + k * 86400.0 as noon from " + _site_days("sun") + ", (values (-1), (0), (1), (2)) k(k))", "noon", "sun")
_TURNS = _settled(f'(select *, noon - 43200.0 as "before" from {_TURNS})', '"before"', "sun", "180.0")
_TURNS = _settled(f'(select *, noon + 43200.0 as "after" from {_TURNS})', '"after"', "sun", "180.0")


@query(f"""{_events(_TURNS, 'sun', {'night': -6.0 - 0.2666})}, f as (select id, camera_id, day, utc, {_alt('sun', 'utc')} < -6.0 as dark from {_AT_SITE})
select id, dark as night, round(min(case when rises = dark and moment > utc then moment end))::bigint as change from f join e using (camera_id, day) group by id, dark""")
def mode_changes(t):
    """When the camera next changes between day and night; null in a polar day or night."""
    return op.mode_changes(t.frames, t.cameras).select("id", F.col("dark").alias("night"), *_whole("change"))


@query(f"""select id, round(passed * 100, 6) as cycle, round((1 - cos(radians(passed * 360.0))) / 2 * 100, 6) as phase, passed < 0.5 as waxing, round(moon_alt, 6) as alt, moon_alt > 0 as up,
 sun_alt < -6.0 and moon_alt >= 0 and (1 - cos(radians(passed * 360.0))) / 2 >= 0.33 as moonlit
from (select id, {_alt('sun', 'utc')} as sun_alt, {_alt('moon', 'utc')} as moon_alt, {_wrap(f'{_moon_lon("utc")} - {_sun_lon("utc")}')} / 360.0 as passed from {_AT_SITE})""")
def moon_state(t):
    """lunation, lit share, altitude and whether a night is moonlit, for every frame at its camera."""
    rows = op.moon_state(t.frames, t.cameras)
    share = {"cycle": F.col("passed") * 100, "phase": F.col("lit") * 100, "alt": F.col("moon_alt")}
    return rows.select("id", *[F.round(c, 6).alias(n) for n, c in share.items()], "waxing", (F.col("moon_alt") > 0).alias("up"), "moonlit")


def _sql_color(i):
    day, dusk, night = (150, 200, 255)[i], (70, 80, 140)[i], (10, 10, 40)[i]
    mix = lambda a, b, s: f"trunc({a} + ({b} - ({a})) * least(1.0, greatest(0.0, {s})))"
    return f"cast(case when alt >= 0 then {day} when alt >= -6 then {mix(dusk, day, '(alt + 6) / 6')} when alt >= -18 then {mix(night, dusk, '(alt + 18) / 12')} else {night} end as int)"


@query(f"select id, {_sql_color(0)} as r, {_sql_color(1)} as g, {_sql_color(2)} as b from (select id, {_alt('sun', 'utc')} as alt from {_AT_SITE})")
def light_graph(t):
    """the colour of the sky's light at each frame."""
    rows = op.at_site(t.frames, t.cameras)
    alt = eph.altitude(eph.sun(F.col("utc")), F.col("latitude"), F.col("longitude"), F.col("utc"))
    return rows.select("id", alt.alias("alt")).select("id", *[c.alias(n) for n, c in zip("rgb", sky.light_color(F.col("alt")), strict=True)])


_S, _M = _sun("moment"), _moon("moment")


@query(f"""with h as (select distinct floor(utc / 3600)::bigint as hour from {_AT_SITE}), m as (select hour, hour * 3600.0::double + m * 60.0 as moment from h, range(0, 60, 5) m(m)),
p as (select hour, radians({_S['ra']}) as sr, radians({_S['dec']}) as sd, radians({_M['ra']}) as mr, radians({_M['dec']}) as md from m),
d as (select hour, degrees(acos(least(1.0, greatest(-1.0, sin(sd) * sin(md) + cos(sd) * cos(md) * cos(sr - mr))))) as apart from p)
select hour, round(min(apart), 6) as nearest, round(max(apart), 6) as farthest, min(apart) < 1.5 as solar, max(apart) > 178.5 as lunar from d group by hour""")
def sun_moon_separation(t):
    """Eclipses looked for in steps of five minutes over every hour that has frames."""
    found = op.conjunctions(op.at_site(t.frames, t.cameras))
    return found.select("hour", F.round("nearest", 6).alias("nearest"), F.round("farthest", 6).alias("farthest"), "solar", "lunar")
