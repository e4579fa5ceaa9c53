"""Estimates of the frame repair over quads of pixels."""

from pyspark.sql import functions as F

from starledger.operators import calibrate as op

from .arrays import PX, _px
from .registry import query

# A stack is a pair of captures; each two by two pixels are a cell of the mosaic. The bad frame
# is the reference times the gains, its greens clipped at a plateau of the pair.
GAIN = {"r": 2.0, "g1": 1.9, "g2": 1.9, "b": 1.8}
_PARTS = (("r", 0, 0), ("g1", 0, 1), ("g2", 1, 0), ("b", 1, 1))
_REFERENCE = {"r": "r * 260 + frame % 11", "g1": "g1 * 250 + 4000", "g2": "g2 * 250 + 4000", "b": "b * 255 + frame % 13"}
_BAD = {"r": "least(65535, ref_r * 2)", "g1": "least(65500 + pair % 3 * 10, ref_g1 * 19 / 10)", "g2": "least(65500 + pair % 3 * 10, ref_g2 * 19 / 10)", "b": "least(65535, ref_b * 9 / 5)"}


def _cells(t):
    at = lambda y, x: F.max(F.when((F.col("y") % 2 == y) & (F.col("x") % 2 == x), F.col("v")))
    px = _px(t)
    quads = px.groupBy(F.col("stack").alias("pair"), "frame", F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(*[at(y, x).alias(n) for n, y, x in _PARTS])
    rows = quads.withColumns({f"ref_{n}": F.expr(e).cast("double") for n, e in _REFERENCE.items()})
    return rows.withColumns({f"bad_{n}": F.expr(e).cast("double") for n, e in _BAD.items()}).withColumn("stable", (F.col("r") + F.col("b")) % 9 > 0)


_CELLS = f"""{PX}, q as (select stack as pair, frame, {", ".join(f"max(v) filter (y % 2 = {y} and x % 2 = {x}) as {n}" for n, y, x in _PARTS)} from px group by stack, frame, y // 2, x // 2),
f as (select *, {", ".join(f"({e})::double as ref_{n}" for n, e in _REFERENCE.items())} from q),
cells as (select *, {", ".join(f"({e})::double as bad_{n}" for n, e in _BAD.items())}, (r + b) % 9 > 0 as stable from f)"""


@query(f"""with {_CELLS}, t as (select unnest([max(bad_g1), max(bad_g2)]) as top from cells group by pair), c as (select top from t where top >= {op.SATURATION}), p as (select count(*) as clipped, round_even(quantile_cont(top, {op.PLATEAU_SHARE}), 0)::int as plateau from c)
select case when abs(greatest(1, plateau - {op.HEADROOM}) - {op.SATURATION}) <= {op.SNAP} then {op.SATURATION} else greatest(1, plateau - {op.HEADROOM}) end as threshold, plateau, clipped, case when clipped = 0 then 'no green plateau: brighter pairs are needed' end as reason from p""")
def repair_saturation(t):
    """The clipping plateau of the greens and the threshold below it."""
    return op.saturation(_cells(t))


_SCORES = f"""{_CELLS}, c(s, e, lo, hi) as (values {", ".join(f"({a}::double, {b}::double, {x}, {y})" for a, b, x, y in op.blends())}),
g as (select pair, least(65535.0, bad_r / 2.0) as r, bad_g1 / 1.9 as g1, bad_g2 / 1.9 as g2, least(65535.0, bad_b / 1.8) as b, ref_r as rr, (ref_g1 + ref_g2) / 2.0 as rg, ref_b as rb from cells where stable and bad_g1 >= 65000 and bad_g2 >= 65000),
u as (select *, greatest(r, b) as high, greatest(r, b) - (greatest(r, b) - least(r, b)) * (greatest(r, b) - least(r, b)) / (2.0 * greatest(r, b)) as base from g where greatest(r, b) > 0 and rg >= {op.LEAST_REFERENCE} and greatest(rr, rg, rb) < 65000),
n as (select pair, count(*) as n from u group by pair having count(*) >= {op.LEAST_OF_PAIR}),
v as (select pair, n, s, e, r, b, rr, rg, rb, (greatest(g1, tg) + greatest(g2, tg)) / 2.0 as g from (select *, base + least(1.0, greatest(0.0, (base / high * {op.BASE_STEPS} - lo) / (hi - lo))) * (high - base) as tg from u join n using (pair), c)),
w as (select s, e, pair, n, median(sqrt((r / (r + g + b) - rr / (rr + rg + rb)) ** 2 + (g / (r + g + b) - rg / (rr + rg + rb)) ** 2 + (b / (r + g + b) - rb / (rr + rg + rb)) ** 2)) as error from v group by all),
scores as (select s as start, e as "end", avg(error) as score, count(*) as pairs, sum(n)::bigint as samples from w group by all)"""


@query(f'with {_SCORES} select start, "end", round(score, 9) as score, pairs, samples from scores')
def repair_blend_scores(t):
    """How well each blend of clipped highlights gives the reference's colours."""
    return op.highlight_scores(_cells(t), GAIN, op.SATURATION).withColumn("score", F.round("score", 9))


@query(f"""with {_SCORES}, b as (select min(score) as best_score, arg_min(start, (score, start, "end")) as best_start, arg_min("end", (score, start, "end")) as best_end, max(score) filter (start = {op.OWN_START} and "end" = {op.OWN_END}) as own_score, coalesce(max(samples), 0) as samples from scores),
o as (select *, own_score <= best_score * {1 + op.OWN_TOLERANCE} as own from b), r as (select case when own then {op.OWN_START}::double else best_start end as start, case when own then {op.OWN_END}::double else best_end end as "end", case when own then own_score else best_score end as score, * from o)
select start, "end", round(score, 9) as score, best_start, best_end, round(best_score, 9) as best_score, own, samples,
 case when samples < {op.LEAST_TOTAL} then 'too few clipped highlights: brighter pairs are needed' when score > {op.WORST_SCORE} then 'no blend fits the highlights' end as reason from r""")
def repair_blend(t):
    """The blend that is taken, with the evidence against it if there is any."""
    found = op.highlight_blend(op.highlight_scores(_cells(t), GAIN, op.SATURATION))
    return found.withColumns({"score": F.round("score", 9), "best_score": F.round("best_score", 9)})
