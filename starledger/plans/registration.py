"""Star patterns of frames registered against their stack's first frame."""

from pyspark.sql import functions as F

from starledger.operators import ordering
from starledger.operators import registration as op

from .registry import query

# The first vector of a stack places twelve stars; each frame of the stack shows them through a
# turn, a scale and a shift of its own, a little off by its own entries, with two strays.
_SHOWN = 12
_MOVE = {"turn": "radians(frame % 41 * 0.7 - 14)", "size": "1 + (frame % 7 - 3) * 0.004", "right": "frame % 13 * 3.5 - 20", "down": "20 - frame % 11 * 4.0"}


def _stars(t):
    frames = t.embeddings.select(F.col("vec_id").alias("frame"), F.col("label").alias("stack"), F.col("embedding").cast("array<double>").alias("e"))
    first = frames.groupBy("stack").agg(F.min(F.struct("frame", "e")).alias("f")).select("stack", F.col("f.frame").alias("target"), F.col("f.e").alias("base"))
    moved = frames.join(first, "stack").withColumns({k: F.expr(v) for k, v in _MOVE.items()})
    each = moved.select("*", F.explode(F.sequence(F.lit(1), F.lit(_SHOWN + 2))).alias("star"))
    get = lambda a, k: F.element_at(F.col(a), k)
    star, own = F.col("star"), F.col("star") > _SHOWN
    x, y = 900 * get("base", star * 2), 900 * get("base", star * 2 + 1)
    c, s = F.col("size") * F.cos("turn"), F.col("size") * F.sin("turn")
    noise = lambda k: F.when(F.col("frame") == F.col("target"), 0.0).otherwise(get("e", k) * 0.2)
    shown = F.col("frame") == F.col("target")
    px = F.when(own, 900 * get("e", star)).when(shown, x).otherwise(c * x - s * y + F.col("right") + noise(star + 30))
    py = F.when(own, 900 * get("e", star + 10)).when(shown, y).otherwise(s * x + c * y + F.col("down") + noise(star + 45))
    return each.select("frame", "stack", "target", "star", px.alias("x"), py.alias("y"), (100.0 - star + 5 * F.sin(F.col("frame") * star)).alias("flux"))


_SQL = f"""with f as (select vec_id as frame, label as stack, embedding::double[] as e from embeddings), o as (select stack, min(frame) as target, arg_min(e, frame) as base from f group by stack),
m as (select frame, stack, target, e, base, {", ".join(f"{v} as {k}" for k, v in _MOVE.items())} from f join o using (stack)),
s as (select *, 900 * base[star * 2] as bx, 900 * base[star * 2 + 1] as by_, size * cos(turn) as c, size * sin(turn) as s from m, range(1, {_SHOWN + 3}) r(star)),
stars as (select frame, target, star, case when star > {_SHOWN} then 900 * e[star] when frame = target then bx else c * bx - s * by_ + "right" + e[star + 30] * 0.2 end as x,
 case when star > {_SHOWN} then 900 * e[star + 10] when frame = target then by_ else s * bx + c * by_ + down + e[star + 45] * 0.2 end as y, 100.0::double - star + 5 * sin(frame * star) as flux from s),
k as (select frame, star, x, y from stars qualify row_number() over (partition by frame order by flux desc, star) <= {op.STARS}),
t0 as (select a.frame, list_sort([{{side: sqrt((b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y)), star: a.star, x: a.x, y: a.y}}, {{side: sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), star: b.star, x: b.x, y: b.y}},
 {{side: sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), star: c.star, x: c.x, y: c.y}}]) as t from k a join k b on a.frame = b.frame and a.star < b.star join k c on a.frame = c.frame and b.star < c.star),
t1 as (select frame, t[3] as a, t[2] as b, t[1] as c, t[1].side / t[3].side as short, t[2].side / t[3].side as mid from t0),
t2 as (select *, floor(short / {op.SHAPE})::int as p, floor(mid / {op.SHAPE})::int as q from t1 where short >= {op.LEAST_SIDE} and mid - short >= {op.LEAST_STEP} and 1 - mid >= {op.LEAST_STEP}),
pairs as (select distinct frame, target from m where frame <> target),
v0 as (select frame, target, own.a, own.b, own.c, g.a as ta, g.b as tb, g.c as tc, own.c.x - own.b.x as ex, own.c.y - own.b.y as ey, g.c.x - g.b.x as eu, g.c.y - g.b.y as ev
 from pairs join t2 own using (frame) join t2 g on g.frame = target and abs(own.p - g.p) <= 1 and abs(own.q - g.q) <= 1),
v1 as (select *, (eu * ex + ev * ey) / (ex * ex + ey * ey) as cc, (ev * ex - eu * ey) / (ex * ex + ey * ey) as ss from v0),
v as (select *, floor(degrees(atan2(ss, cc)) / {op.TURN})::int as b1, floor(ln(sqrt(cc * cc + ss * ss)) / {op.SCALE})::int as b2, floor((ta.x - cc * a.x + ss * a.y) / {op.SHIFT})::int as b3, floor((ta.y - ss * a.x - cc * a.y) / {op.SHIFT})::int as b4 from v1),
w0 as (select frame, target, b1 - i1 as w1, b2 - i2 as w2, b3 - i3 as w3, b4 - i4 as w4, count(*) as votes from v, (values (0), (1)) x1(i1), (values (0), (1)) x2(i2), (values (0), (1)) x3(i3), (values (0), (1)) x4(i4) group by all),
w as (select * from w0 where votes >= {op.LEAST_VOTES} qualify row_number() over (partition by frame, target order by votes desc, w1, w2, w3, w4) = 1),
g as (select v.* from v join w using (frame, target) where b1 - w1 in (0, 1) and b2 - w2 in (0, 1) and b3 - w3 in (0, 1) and b4 - w4 in (0, 1)),
p as (select frame, target, a.star as star, ta.star as too, a.x as x, a.y as y, ta.x as u, ta.y as v from g union select frame, target, b.star, tb.star, b.x, b.y, tb.x, tb.y from g union select frame, target, c.star, tc.star, c.x, c.y, tc.x, tc.y from g),
"""
_FIT = """{0}0 as (select frame, target, count(*) as n, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv, sum(x * x + y * y) as zz, sum(x * u + y * v) as zc, sum(x * v - y * u) as zs from {1} group by all),
{0}1 as (select *, (zc - n * (mx * mu + my * mv)) / (zz - n * (mx * mx + my * my)) as c, (zs - n * (mx * mv - my * mu)) / (zz - n * (mx * mx + my * my)) as s from {0}0),
{0} as (select *, mu - c * mx + s * my as dx, mv - s * mx - c * my as dy from {0}1)"""
_REGISTERED = (
    _SQL
    + _FIT.format("h", "p")
    + f""", i as (select h.frame, target, k.x, k.y, z.x as u, z.y as v from h join k on k.frame = h.frame join k z on z.frame = target
 where (c * k.x - s * k.y + dx - z.x) * (c * k.x - s * k.y + dx - z.x) + (s * k.x + c * k.y + dy - z.y) * (s * k.x + c * k.y + dy - z.y) <= {op.TOLERANCE * op.TOLERANCE}),
"""
    + _FIT.format("j", "i")
    + ", final as (select frame, target, votes, n, degrees(atan2(s, c)) as rotation, sqrt(c * c + s * s) as scale, dx, dy from j join w using (frame, target) where n >= 3)"
)


def _registered(t):
    stars = _stars(t)
    pairs = stars.where("star = 1 and frame <> target").select("frame", "target")
    return op.registered(pairs, stars.select("frame", "star", "x", "y", "flux"))


@query(f"{_REGISTERED} select frame, target, votes, n, round(rotation, 5) as rotation, round(scale, 7) as scale, round(dx, 4) as dx, round(dy, 4) as dy from final")
def registration(t):
    """Turn, scale and shift of each frame against its stack's first."""
    found = _registered(t)
    return found.select("frame", "target", "votes", "n", F.round("rotation", 5).alias("rotation"), F.round("scale", 7).alias("scale"), F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query(f"""{_REGISTERED.replace('with f as', 'with recursive f as', 1)}, y as (select frame, target, rotation, row_number() over (partition by target order by frame) as k from final),
r as (select distinct target, 0::bigint as k, null::bigint as frame, false as taken, 0::bigint as n, 0.0::double as mean, 0.0::double as m2 from y
union all select target, k, frame, ok, case when ok then n + 1 else n end, case when ok then mean + (v - mean) / (n + 1) else mean end, case when ok then m2 + (v - mean) * (v - (mean + (v - mean) / (n + 1))) else m2 end
 from (select r.target, y.k, y.frame, y.rotation as v, r.n, r.mean, r.m2, r.n < 15 or abs(y.rotation - r.mean) <= 3.0 * sqrt(r.m2 / r.n) as ok from r join y on y.target = r.target and y.k = r.k + 1) s)
select frame, target, taken from r where frame is not null""")
def registration_gate(t):
    """Which frames' rotation the history of their stack lets through."""
    rows = _registered(t).select(F.col("frame").alias("id"), F.col("target").alias("camera_id"), F.col("rotation").alias("adu"))
    gated = ordering.by_batches(rows, "camera_id", ["id"], ordering.Gate, "id bigint, camera_id bigint, taken boolean")
    return gated.select(F.col("id").alias("frame"), F.col("camera_id").alias("target"), "taken")
