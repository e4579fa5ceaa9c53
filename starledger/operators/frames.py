"""Frame operators over pixel tables and arrays.

A pixel table has frame, y, x, v (and c for a channel). Per-pixel arithmetic, stacks and
statistics are columns and aggregations; what looks at a neighbourhood in a whole frame is
numpy over Arrow batches of frames (``kernels``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import placed

#: Frame numbers to a slot in which a stack's frames are numbered.
FRAME_SLOT = 1000


def pixels(frames: DataFrame, width: int, values: str = "values", also: tuple[str, ...] = ()) -> DataFrame:
    """frame, stack, the columns ``also``, y, x, v from rows of whole frames."""
    spread = frames.select("frame", "stack", *also, F.posexplode(values).alias("at", "v"))
    return spread.select("frame", "stack", *also, F.floor(F.col("at") / width).cast("int").alias("y"), (F.col("at") % width).alias("x"), "v")


def stack(px: DataFrame, how: str) -> DataFrame:
    """One value a pixel of each stack; the mean is cut to whole numbers."""
    made = {"average": F.floor(F.avg("v")).cast("int"), "maximum": F.max("v"), "minimum": F.min("v")}[how]
    return px.groupBy("stack", "y", "x").agg(made.alias("v"))


def sliding_stack(px: DataFrame, n: int, how: str = "maximum", same: tuple[str, ...] = (), flagged: str | None = None) -> DataFrame:
    """Each frame stacked with the up to n - 1 frames before it.

    Flagged frames are in no stack, their own included, and frames are stacked with those that
    agree in the columns ``same``, such as the exposure.
    """
    px = px if flagged is None else px.where(~F.col(flagged))
    w = Window.partitionBy("stack", *same, "y", "x").orderBy("frame").rowsBetween(-(n - 1), 0)
    return px.withColumn("v", {"maximum": F.max, "minimum": F.min}[how]("v").over(w))


def clipped_stack(px: DataFrame, sigmas: float) -> DataFrame:
    """Mean without the values further than ``sigmas`` deviations from the pixel's median."""
    key = ["stack", "y", "x"]
    centre = px.groupBy(*key).agg(F.percentile("v", 0.5).alias("median"), F.stddev_pop("v").alias("deviation"))
    near = px.join(centre, key).where(F.abs(F.col("v") - F.col("median")) <= sigmas * F.col("deviation"))
    return near.groupBy(*key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def hot_pixels(px: DataFrame, threshold: int) -> DataFrame:
    """The bad-pixel map, zero below the threshold, and how many pixels are hot."""
    top = stack(px, "maximum").withColumn("v", F.when(F.col("v") >= threshold, F.col("v")).otherwise(0))
    return top.withColumn("hot", F.count_if(F.col("v") > 0).over(Window.partitionBy("stack")))


def master_dark(px: DataFrame, threshold: int) -> DataFrame:
    """Stack, y, x, v: the mean of each pixel, cut, or its maximum where that is hot, in one aggregation."""
    top = F.max("v")
    return px.groupBy("stack", "y", "x").agg(F.greatest(F.floor(F.avg("v")).cast("int"), F.when(top >= threshold, top).otherwise(0)).alias("v"))


def gamma(v: Column, g: float, top: int = 255) -> Column:
    """N12."""
    return F.floor(F.pow(v / top, F.lit(1.0 / g)) * top).cast("int")


def deviation_stretch(px: DataFrame, sigmas: float, top: int = 255) -> DataFrame:
    """Levels from mean - sigmas deviations to the top, clipped."""
    stats = px.groupBy("frame").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    low = F.greatest(F.lit(0.0), F.col("mean") - sigmas * F.col("deviation"))
    out = F.least(F.lit(float(top)), F.greatest(F.lit(0.0), (F.col("v") - low) * top / (top - low)))
    # rounded first, so that a level that is a whole number but for its last bits is not cut below it
    return px.join(stats, "frame").withColumn("v", F.floor(F.round(out, 6)).cast("int")).drop("mean", "deviation")


def midtones(x: Column, m: Column | float) -> Column:
    """The midtones transfer function of a value from 0 to 1."""
    m = m if isinstance(m, Column) else F.lit(m)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def adaptive_midtones(px: DataFrame, stride: int = 2, target: float = 0.25, clip: float = -2.8, top: int = 255) -> DataFrame:
    """Shadows and midtones from the median and deviation of each stride-th row and column."""
    x = F.col("v") / top
    sample = px.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).withColumn("s", x)
    first = sample.groupBy("frame").agg(F.percentile("s", 0.5).alias("median"))
    spread = sample.join(first, "frame").groupBy("frame", "median").agg((F.percentile(F.abs(F.col("s") - F.col("median")), 0.5) * 1.4826).alias("mad"))
    shadow = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("median") + clip * F.col("mad")))
    level = spread.withColumn("shadow", shadow).withColumn("m", midtones(F.col("median") - F.col("shadow"), target))
    cut = F.greatest(F.lit(0.0), (x - F.col("shadow")) / (1 - F.col("shadow")))
    return px.join(level, "frame").withColumn("v", F.floor(F.round(midtones(cut, F.col("m")) * top, 6)).cast("int")).select(px.columns)


def color_matrix(matrix: list[list[float]], r: Column, g: Column, b: Column, top: int = 255) -> list[Column]:
    """Corrected channels, clipped and cut."""
    return [F.floor(F.least(F.lit(float(top)), F.greatest(F.lit(0.0), a * r + c * g + d * b))).cast("int") for a, c, d in matrix]


def balanced(r: Column, g: Column, b: Column, factors: tuple[float, float, float], top: int = 255) -> list[Column]:
    """Channels times given factors, rounded to the even and clipped."""
    return [F.least(F.lit(top), F.bround(c * f)).cast("int") for c, f in zip((r, g, b), factors, strict=True)]


def midtone_levels(v: Column, m: float, top: int = 255) -> Column:
    """A level of a channel through the midtones function."""
    return F.floor(F.round(midtones(v / top, m) * top, 6)).cast("int")


def saturated(r: Column, g: Column, b: Column, factor: float) -> list[Column]:
    """Saturation times a factor, hue and value kept: a channel's distance from the greatest grows, down to zero at most."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    grown = F.when(most > least, F.least(F.lit(factor), most / (most - least))).otherwise(1.0)
    return [F.bround(F.round(most - (most - c) * grown, 6)).cast("int") for c in (r, g, b)]


def heat_colors(v: Column, top: int = 255) -> list[Column]:
    """The usual blue to red colours of a grey level, piecewise linear."""
    ramp = lambda centre: F.bround(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.5 - F.abs(4.0 * v / top - centre))) * 255, 6)).cast("int")
    return [ramp(3), ramp(2), ramp(1)]


def less_green(mode: str, r: Column, g: Column, b: Column, amount: float = 1.0) -> Column:
    """The green channel with its cast removed."""
    if mode == "average":
        return F.least(g, (r + b) / 2)
    if mode == "maximum":
        return F.least(g, F.greatest(r, b))
    if mode == "additive":
        m = F.least(F.lit(1.0), (r + b) / 255.0)
        return g * (1 - amount) * (1 - m) + m * g
    if mode == "midtones":
        return midtone_levels(g, amount)
    raise ValueError(mode)


def moved(px: DataFrame, how: str, size: int) -> DataFrame:
    """Quarter turns and flips of square frames, as arithmetic on the places."""
    y, x, last = F.col("y"), F.col("x"), size - 1
    to = {"rotate90": (x, last - y), "rotate180": (last - y, last - x), "rotate270": (last - x, y), "flip_x": (y, last - x), "flip_y": (last - y, x)}[how]
    return px.withColumns({"y": to[0].cast("int"), "x": to[1].cast("int")})


def crop(px: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """N21."""
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + width) & (F.col("y") >= y0) & (F.col("y") < y0 + height)
    return px.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def scaled_down(px: DataFrame, factor: int) -> DataFrame:
    """Frames at a whole fraction of their size, by the mean of what a new pixel covers."""
    to = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return px.groupBy("frame", to("y"), to("x")).agg(F.bround(F.avg("v")).cast("int").alias("v"))


def bordered(px: DataFrame, top: int, left: int, bottom: int, right: int, height: int, width: int, level: int = 0) -> DataFrame:
    """Frames of ``height`` by ``width`` with a border of one level around them."""
    moved_in = px.select("frame", (F.col("y") + top).cast("int").alias("y"), (F.col("x") + left).cast("int").alias("x"), "v")
    across = F.explode(F.sequence(F.lit(0), F.lit(left + width + right - 1)))
    grid = px.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(top + height + bottom - 1))).alias("y")).select("frame", "y", across.alias("x"))
    inner = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
    return moved_in.union(grid.where(~inner).select("frame", "y", "x", F.lit(level).cast(px.schema["v"].dataType).alias("v")))


def in_box(x0: int, y0: int, x1: int, y1: int) -> Column:
    """Inside a region of interest, ends excluded."""
    return (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)


def in_circle(size: int, radius: float) -> Column:
    """N22, A23."""
    c = (size - 1) / 2
    return F.pow(F.col("x") - c, 2) + F.pow(F.col("y") - c, 2) <= radius * radius


def frame_places(px: DataFrame) -> DataFrame:
    """(stack, frame, col): each frame's place in its stack, numbered in slots of frames."""
    return placed(px.select("stack", "frame").distinct(), ["stack"], [F.floor(F.col("frame") / FRAME_SLOT)], [F.col("frame")]).select("stack", "frame", (F.col("at") - 1).cast("int").alias("col"))


def keogram(px: DataFrame, width: int) -> DataFrame:
    """The middle column of each frame by the frame's place in its stack."""
    return px.where(F.col("x") == width // 2).join(frame_places(px), ["stack", "frame"]).select("stack", "col", "y", "v")


def turned_keogram(px: DataFrame, size: int, degrees: float, offset: tuple[int, int], top: int, bottom: int, factor: int) -> DataFrame:
    """The column through the sky's centre, ``offset`` from the frame's, turned by an angle, trimmed and shrunk.

    Row y of the column is read at the pixel nearest to where the turn puts it; rows outside the
    frame are zero. ``top`` and ``bottom`` rows are cut off, then ``factor`` rows become their mean.
    """
    c, a = (size - 1) / 2, math.radians(degrees)
    rows = [(y, math.floor(c + offset[1] + (y - c) * math.cos(a) + 0.5), math.floor(c + offset[0] - (y - c) * math.sin(a) + 0.5)) for y in range(top, size - bottom)]
    # a row of the frame's height each, the same for all frames
    line = F.broadcast(px.sparkSession.createDataFrame(rows, "row int, y int, x int"))
    frames = frame_places(px).select("stack", "frame", "col", F.explode(F.sequence(F.lit(top), F.lit(size - bottom - 1))).alias("row"))
    read = px.join(line, ["y", "x"]).select("stack", "frame", "row", "v")
    whole = frames.join(read, ["stack", "frame", "row"], "left")
    return whole.groupBy("stack", "col", F.floor((F.col("row") - top) / factor).cast("int").alias("y")).agg(F.bround(F.avg(F.coalesce("v", F.lit(0)))).cast("int").alias("v"))


def trail_gates(limits: dict[str, float]) -> list[tuple[str, Column]]:
    """The six reasons to leave a frame out of a star trail, in their order.

    Looks at sun_alt, moon_alt, moon_phase, adu, bright (pixels above the mask's level) and stars.
    """
    moon = lambda kind: (F.col("moon_alt") > limits[f"{kind}_alt"]) & (F.col("moon_phase") > limits[f"{kind}_phase"])
    few = F.col("stars") < limits["stars"] if limits["stars"] > 0 else F.lit(False)
    return [("sun_alt", F.col("sun_alt") > limits["sun_alt"]), ("moon_mode", moon("moonmode")), ("moon_alt", moon("moon")), ("adu", F.col("adu") > limits["adu"]), ("pixels", F.col("bright") > limits["bright"]), ("stars", few)]


def star_trail(px: DataFrame, gates: Column) -> DataFrame:
    """The lightest value of each pixel over the frames that pass the gates."""
    return px.where(gates).groupBy("stack", "y", "x").agg(F.max("v").alias("v"))


def calendar_grid(buckets: DataFrame, first: int, last: int, per_day: int, channels: list[str]) -> DataFrame:
    """All days and places of a day, zero where no bucket is; values cut to a byte.

    ``buckets``: bucket (number since the epoch, ``per_day`` a day) and channels.
    """
    grid = buckets.sparkSession.range(first, last + 1).select(F.col("id").alias("bucket"))
    filled = [F.least(F.lit(255), F.greatest(F.lit(0), F.coalesce(F.floor(c), F.lit(0)))).cast("int").alias(c) for c in channels]
    return grid.join(buckets, "bucket", "left").select(F.floor(F.col("bucket") / per_day).alias("day"), (F.col("bucket") % per_day).cast("int").alias("place"), *filled)


def bayer_signature(px: DataFrame, ratio: float) -> DataFrame:
    """Medians of the four parities and whether red and blue both stand out over green."""
    parity = {n: F.percentile(F.when((F.col("y") % 2 == a) & (F.col("x") % 2 == b), F.col("v")), 0.5).alias(n) for n, a, b in (("r", 0, 0), ("g1", 0, 1), ("g2", 1, 0), ("b", 1, 1))}
    got = px.groupBy("frame").agg(*parity.values()).withColumn("green", (F.col("g1") + F.col("g2")) / 2)
    got = got.withColumns({"red_ratio": F.col("r") / F.col("green"), "blue_ratio": F.col("b") / F.col("green"), "purple_ratio": (F.col("r") + F.col("b")) / 2 / F.col("green")})
    return got.withColumn("is_bad", (F.col("red_ratio") >= ratio) & (F.col("blue_ratio") >= ratio) & (F.col("purple_ratio") >= ratio))


def bit_depth(px: DataFrame) -> DataFrame:
    """The least usual depth that holds the frame's greatest value."""
    top = F.max("v")
    depth = F.lit(16)
    for bits in (14, 12, 10, 8):
        depth = F.when(top < 2**bits, bits).otherwise(depth)
    return px.groupBy("frame").agg(depth.alias("depth"))


def panorama(px: DataFrame, size: int, columns: int, rows: int) -> DataFrame:
    """The round frame unrolled: a column is a direction, a row a distance from the edge in."""
    c = (size - 1) / 2
    # the map is columns by rows, the same for every frame and no larger than one
    turns = px.sparkSession.range(columns).select(F.col("id").cast("int").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    r, a = c - F.col("row") * (c / rows), F.col("col") * (2 * math.pi / columns)
    where = turns.select("col", "row", F.floor(c + r * F.sin(a) + 0.5).cast("int").alias("x"), F.floor(c - r * F.cos(a) + 0.5).cast("int").alias("y"))
    return px.join(F.broadcast(where), ["y", "x"]).select("frame", "row", "col", "v")
