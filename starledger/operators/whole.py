"""Statistics and calibration of whole frames (N7, N13, N15, N18): a frame is one row and stays one.

Values are an array a frame, row by row. What one frame says about itself needs no shuffle: it
is worked out within the row. Only masters meet frames, one array a stack; pixels are spread, if
at all, after everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import midtones


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, not once a pixel."""
    return F.element_at(F.transform(F.array(value), then), 1)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def deviation(values: Column, centre: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre)) / F.size(values))


def median(values: Column) -> Column:
    """Of an array without nulls; the mean of the middle two if their number is even."""
    at = lambda s, k: F.element_at(s, k.cast("int"))
    return _bound(F.array_sort(values), lambda s: (at(s, F.floor((F.size(s) + 1) / 2)) + at(s, F.floor(F.size(s) / 2) + 1)) / 2)


def deviation_stretch(values: Column, sigmas: float, top: int = 255) -> Column:
    """Levels from mean - sigmas deviations to the top, clipped."""
    level = lambda v, low: F.floor(F.round(F.least(F.lit(float(top)), F.greatest(F.lit(0.0), (v - low) * top / (top - low))), 6)).cast("int")
    lowest = _bound(mean(values), lambda m: F.greatest(F.lit(0.0), m - sigmas * deviation(values, m)))
    return _bound(lowest, lambda low: F.transform(values, lambda v: level(v, low)))


def adaptive_stretch(values: Column, width: int, stride: int = 2, target: float = 0.25, clip: float = -2.8, top: int = 255) -> Column:
    """Shadows and midtones from the median and deviation of each stride-th row and column."""
    chosen = F.filter(values, lambda v, i: (F.floor(i / width) % stride == 0) & (i % width % stride == 0))
    sample = F.transform(chosen, lambda v: v.cast("double") / top)
    spread = lambda s, m: _bound(median(F.transform(s, lambda v: F.abs(v - m))) * 1.4826, lambda mad: F.struct(m.alias("m"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), m + clip * mad)).alias("shadow")))
    levels = _bound(sample, lambda s: _bound(median(s), lambda m: spread(s, m)))
    tuned = _bound(levels, lambda c: F.struct(c["shadow"].alias("shadow"), midtones(c["m"] - c["shadow"], target).alias("m")))
    cut = lambda v, c: F.greatest(F.lit(0.0), (v.cast("double") / top - c["shadow"]) / (1 - c["shadow"]))
    return _bound(tuned, lambda c: F.transform(values, lambda v: F.floor(F.round(midtones(cut(v, c), c["m"]) * top, 6)).cast("int")))


def grey_world(r: Column, g: Column, b: Column, top: int = 255) -> list[Column]:
    """Channels scaled so that their means agree; a black channel counts as 0.1."""
    grey = (mean(r) + mean(g) + mean(b)) / 3
    part = lambda c: _bound(F.struct(grey.alias("grey"), mean(c).alias("own")), lambda s: F.transform(c, lambda v: F.bround(F.least(F.lit(float(top)), v * s["grey"] / F.when(s["own"] == 0, 0.1).otherwise(s["own"]))).cast("int")))
    return [part(c) for c in (r, g, b)]


def master_of(px: DataFrame) -> DataFrame:
    """stack, master: a pixel table of one frame a stack (stack, y, x, v) as arrays, row by row, and their shape."""
    cell = F.struct("y", "x", "v")
    rows = px.groupBy("stack").agg(F.array_sort(F.collect_list(cell)).alias("cells"), (F.max("y") + 1).alias("master_height"), (F.max("x") + 1).alias("master_width"))
    return rows.select("stack", F.transform("cells", lambda c: c["v"]).alias("master"), "master_height", "master_width")


def calibrated(frames: DataFrame, masters: DataFrame, width: int) -> DataFrame:
    """The stack's master off each frame, never below zero.

    A frame of another shape than its master, or without one, stays as it is; ``calibrated``
    says which. ``frames``: frame, stack, values; ``masters``: as ``master_of`` gives them.
    """
    met = frames.join(masters, "stack", "left")
    fits = F.coalesce((F.col("master_width") == width) & (F.size("values") == F.col("master_height") * width) & (F.size("master") == F.size("values")), F.lit(False))
    off = F.zip_with("values", "master", lambda v, m: F.greatest(v - m, F.lit(0)))
    return met.withColumn("calibrated", fits).withColumn("values", F.when(F.col("calibrated"), off).otherwise(F.col("values"))).select(*frames.columns, "calibrated")
