"""Registration of frames by star patterns.

The brightest stars of a frame make triangles. Shape, not place, says which triangles of two
frames belong together: the ratios of the sides are quantised and joined by equality. Each match
votes for a turn, a scale and a shift, the votes are counted, and the stars that the winning
bin pairs are fitted by least squares from sums. Nothing but the few stars of each frame is
ever spread: at most ``STARS`` over three triangles a frame, so no frame is too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.sources.sinks import stored

#: Stars of a frame that make triangles.
STARS = 8
#: Width of a bin of the sides' ratios, least ratio of the shortest side, least difference of two ratios.
SHAPE, LEAST_SIDE, LEAST_STEP = 0.01, 0.1, 0.03
#: Half widths of the votes' bins: degrees, natural logarithm of the scale, pixels of the shift.
TURN, SCALE, SHIFT = 0.75, 0.01, 6.0
#: Votes below which two frames do not belong together, and pixels to which stars must agree in the end.
LEAST_VOTES, TOLERANCE = 4, 2.0
CORNERS = ("a", "b", "c")


def kept(stars: DataFrame, most: int = STARS) -> DataFrame:
    """The brightest stars of each frame as rows; equal ones by number. ``stars``: frame, star, x, y, flux."""
    nth = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("flux"), "star"))
    return stars.withColumn("nth", nth).where(F.col("nth") <= most).select("frame", "star", "x", "y")


def triangles(stars: DataFrame) -> DataFrame:
    """frame, the corners' star, x and y, and the shape of every triangle of ``kept`` stars.

    Corners a, b and c lie opposite the longest, the middle and the shortest side. Triangles
    that are nearly flat at a corner or have two sides nearly alike are left out, as noise could
    swap their corners.
    """
    one = lambda k: stars.select("frame", *[F.col(c).alias(f"{c}{k}") for c in ("star", "x", "y")])
    met = one(1).join(one(2), "frame").where("star1 < star2").join(one(3), "frame").where("star2 < star3")
    side = lambda p, q: F.sqrt((F.col(f"x{p}") - F.col(f"x{q}")) * (F.col(f"x{p}") - F.col(f"x{q}")) + (F.col(f"y{p}") - F.col(f"y{q}")) * (F.col(f"y{p}") - F.col(f"y{q}")))
    corner = lambda k, p, q: F.struct(side(p, q).alias("side"), F.col(f"star{k}").alias("star"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    ordered = met.select("frame", F.array_sort(F.array(corner(1, 2, 3), corner(2, 1, 3), corner(3, 1, 2))).alias("t"))
    rows = ordered.select("frame", *[F.col("t")[2 - i][c].alias(f"{c}_{n}") for i, n in enumerate(CORNERS) for c in ("side", "star", "x", "y")])
    rows = rows.withColumns({"short": F.col("side_c") / F.col("side_a"), "middle": F.col("side_b") / F.col("side_a")})
    return rows.where((F.col("short") >= LEAST_SIDE) & (F.col("middle") - F.col("short") >= LEAST_STEP) & (1 - F.col("middle") >= LEAST_STEP)).drop(*[f"side_{n}" for n in CORNERS])


def _bin(c: str) -> Column:
    return F.floor(F.col(c) / SHAPE).cast("int")


def _turned(x1: Column, y1: Column, x2: Column, y2: Column, u1: Column, v1: Column, u2: Column, v2: Column) -> tuple[Column, Column]:
    """Cosine and sine parts of the similarity that takes 1 to 2 as u, v."""
    dx, dy, du, dv = x2 - x1, y2 - y1, u2 - u1, v2 - v1
    square = dx * dx + dy * dy
    return (du * dx + dv * dy) / square, (dv * dx - du * dy) / square


def votes(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """frame, target, both corners' stars and places, and the bins of turn, scale and shift of every match of two triangles.

    ``pairs``: frame, target. The target's triangles lie in their bin of shape, the frame's in
    it and those around.
    """
    target = shapes.select(F.col("frame").alias("target"), *[F.col(f"{c}_{n}").alias(f"{to}_{n}") for n in CORNERS for c, to in (("star", "to"), ("x", "u"), ("y", "v"))], _bin("short").alias("p"), _bin("middle").alias("q"))
    around = F.explode(F.array(*[F.struct((_bin("short") + i).alias("p"), (_bin("middle") + j).alias("q")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("k")
    own = shapes.join(pairs, "frame").select("*", around).select("*", "k.p", "k.q").drop("k", "short", "middle")
    met = own.join(target, ["target", "p", "q"])
    c, s = _turned(*[F.col(f"{n}_{k}") for k in ("b", "c") for n in ("x", "y")], *[F.col(f"{n}_{k}") for k in ("b", "c") for n in ("u", "v")])
    met = met.withColumns({"c": c, "s": s})
    bins = {
        "turn": F.floor(F.degrees(F.atan2("s", "c")) / TURN).cast("int"),
        "scale": F.floor(F.log(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))) / SCALE).cast("int"),
        "right": F.floor((F.col("u_a") - F.col("c") * F.col("x_a") + F.col("s") * F.col("y_a")) / SHIFT).cast("int"),
        "down": F.floor((F.col("v_a") - F.col("s") * F.col("x_a") - F.col("c") * F.col("y_a")) / SHIFT).cast("int"),
    }
    return met.withColumns(bins)


BINS = ["turn", "scale", "right", "down"]


def winners(cast: DataFrame) -> DataFrame:
    """frame, target, the bin with the most votes (of equal ones the least) and their number.

    Bins overlap by half, so a vote counts in two a dimension and none is cut off at an edge.
    """
    for b in BINS:
        cast = cast.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b))))
    counts = cast.groupBy("frame", "target", *BINS).agg(F.count("*").alias("votes"))
    best = counts.groupBy("frame", "target").agg(F.min(F.struct((-F.col("votes")).alias("less"), *BINS)).alias("w"))
    return best.select("frame", "target", *[F.col(f"w.{b}").alias(f"w_{b}") for b in BINS], (-F.col("w.less")).alias("votes"))


def _fitted(points: DataFrame) -> DataFrame:
    """frame, target, n, c, s, dx, dy: the similarity (u = c x - s y + dx, v = s x + c y + dy) of least squares over paired points."""
    total = lambda e, n: F.sum(e).alias(n)
    x, y, u, v = (F.col(n) for n in "xyuv")
    sums = points.groupBy("frame", "target").agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m{n}") for n in "xyuv"], total(x * x + y * y, "zz"), total(x * u + y * v, "zc"), total(x * v - y * u, "zs"))
    mx, my, mu, mv = (F.col(f"m{n}") for n in "xyuv")
    spread = F.col("zz") - F.col("n") * (mx * mx + my * my)
    fit = sums.withColumns({"c": (F.col("zc") - F.col("n") * (mx * mu + my * mv)) / spread, "s": (F.col("zs") - F.col("n") * (mx * mv - my * mu)) / spread})
    return fit.select("frame", "target", "n", "c", "s", (mu - F.col("c") * mx + F.col("s") * my).alias("dx"), (mv - F.col("s") * mx - F.col("c") * my).alias("dy"))


def registered(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """Frame, target, votes, n, rotation (degrees), scale, dx, dy of each pair of frames that belong together.

    ``pairs``: frame, target; ``stars``: frame, star, x, y, flux. The winning bin
    pairs stars; the fit over them is done again over all bright stars that it brings
    within ``TOLERANCE`` of one of the target. Pairs with fewer than ``LEAST_VOTES`` votes in a
    bin, or fewer than three stars in the end, have no row.
    """
    bright = stored(kept(stars), "bright")
    cast = stored(votes(pairs, triangles(bright)), "votes")
    won = winners(cast).where(F.col("votes") >= LEAST_VOTES)
    near = None
    for b in BINS:
        ok = (F.col(b) - F.col(f"w_{b}")).isin(0, 1)
        near = ok if near is None else near & ok
    agreed = cast.join(won, ["frame", "target"]).where(near)
    paired = agreed.select("frame", "target", "votes", F.explode(F.array(*[F.struct(*[F.col(f"{c}_{n}").alias(c) for c in ("star", "to", "x", "y", "u", "v")]) for n in CORNERS])).alias("m")).select("frame", "target", "votes", "m.*").distinct()
    first = _fitted(paired)
    moved = first.join(bright, "frame").select("frame", "target", "star", "x", "y", (F.col("c") * F.col("x") - F.col("s") * F.col("y") + F.col("dx")).alias("px"), (F.col("s") * F.col("x") + F.col("c") * F.col("y") + F.col("dy")).alias("py"))
    goal = bright.select(F.col("frame").alias("target"), F.col("star").alias("to"), F.col("x").alias("u"), F.col("y").alias("v"))
    off = (F.col("px") - F.col("u")) * (F.col("px") - F.col("u")) + (F.col("py") - F.col("v")) * (F.col("py") - F.col("v"))
    inside = moved.join(goal, "target").withColumn("off", off).where(F.col("off") <= TOLERANCE * TOLERANCE)
    final = _fitted(inside).where("n >= 3").join(won.select("frame", "target", "votes"), ["frame", "target"])
    size = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    return final.select("frame", "target", "votes", "n", F.degrees(F.atan2("s", "c")).alias("rotation"), size.alias("scale"), "dx", "dy")
