"""Calibration and repair of frames whose raw stream was shifted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import robust

#: Usable range of samples, least samples and pairs, blend of clipped highlights.
LOW, HIGH, SOURCE_HIGH, LEAST_SAMPLES, LEAST_PAIRS = 256, 60_000, 62_000, 4, 3
BLEND_START, BLEND_END = 0.70, 0.90
PARITIES = ("r", "g1", "g2", "b")


def gains(samples: DataFrame, low: int = LOW, high: int = HIGH, source_high: int = SOURCE_HIGH, least: int = LEAST_SAMPLES) -> DataFrame:
    """Parity, gain, mad, relative_mad, pairs.

    ``samples``: pair, parity, bad, reference, stable. Each pair gives one median a parity, of
    the ratios between its 10 % and 90 % quantiles, so that no clear frame outweighs others.
    """
    good = samples.where(F.col("stable") & F.col("reference").between(low, high) & F.col("bad").between(low, source_high)).withColumn("ratio", F.col("bad") / F.col("reference"))
    sized = good.groupBy("pair", "parity").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    per_pair = robust(good.join(sized.drop("n"), ["pair", "parity"]), ["pair", "parity"], "ratio").select("parity", F.col("trimmed_median").alias("gain"))
    over = robust(per_pair, ["parity"], "gain").select("parity", F.col("median").alias("gain"), "mad", "relative_mad")
    return over.join(per_pair.groupBy("parity").agg(F.count("*").alias("pairs")), "parity")


def repaired(a: np.ndarray, gain: tuple[float, float, float, float], saturation: int) -> np.ndarray:
    """A mosaic with its gains undone and clipped greens rebuilt from what is left.

    A clipped first green takes the mean of the second greens around it where that is greater.
    Where both greens are clipped, red and blue guide them: with h the greater and l the lesser,
    the base is h - (h - l)^2 / 2h, and between the blend's ratios of base to h it moves to h.
    """
    out = np.empty_like(a, dtype=np.float64)
    planes = ((0, 0), (0, 1), (1, 0), (1, 1))
    for (y, x), g in zip(planes, gain, strict=True):
        out[y::2, x::2] = np.rint(np.clip(a[y::2, x::2] / g, 0, 65535))
    r, g1, g2, b = (out[y::2, x::2] for y, x in planes)
    clip1, clip2 = a[0::2, 1::2] >= saturation, a[1::2, 0::2] >= saturation
    above = np.vstack((g2[:1], g2[:-1]))
    right = lambda p: np.hstack((p[:, 1:], p[:, -1:]))
    around = np.rint((above + right(above) + g2 + right(g2)) / 4)
    np.copyto(g1, around, where=clip1 & (around > g1))
    hi, lo = np.maximum(r, b), np.minimum(r, b)
    base = np.where(hi > 0, hi - (hi - lo) ** 2 / np.maximum(2 * hi, 1), 0)
    share = np.clip((base / np.maximum(hi, 1) - BLEND_START) / (BLEND_END - BLEND_START), 0, 1)
    green = np.floor(base + share * (hi - base))
    both = clip1 & clip2
    for g in (g1, g2):
        np.copyto(g, green, where=both & (green > g))
    return out
