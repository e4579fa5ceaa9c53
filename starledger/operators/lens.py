"""Lens fit (N38): a coarse search in Spark, then each frame's refinement in a task of its own.

Parameters are azimuth, latitude and longitude offset (degrees; the lens's tilt as a shift of
the site), diameter and centre offsets (pixels) of an equal-area fisheye. The coarse search
places every star under every candidate of a grid and counts, by frame and candidate, the stars
that have a detection near them: candidates times stars are rows, and cells of the match radius
join them to detections by equality. The best few candidates of a frame go to its task, with its
stars and detections, of which a frame has some thousand at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger.functions import sky

from .joins import nearest_in_cells

#: Search step (degrees), match radii (shares of the diameter, pixels), least altitude (degrees), gates.
AZIMUTH_STEP, MATCH_SHARE, LEAST_RADIUS, LEAST_ALTITUDE = 7.5, 0.02, 8.0, 10.0
LEAST_MATCHED, RMS_SHARE, RMS_FLOOR = 40, 0.005, 5.0
#: Parameters of the grid around the guess: shares of the diameter, offsets (pixels), starts to refine, largest tilt (degrees).
DIAMETERS, OFFSETS, STARTS, MOST_TILT = (0.8, 0.9, 1.0, 1.1, 1.25), (-100.0, -50.0, 0.0, 50.0, 100.0), 4, 10.0
FIT = "frame bigint, success boolean, reason string, azimuth double, latitude_offset double, longitude_offset double, diameter double, offset_x double, offset_y double, rms double, matched int"


def horizontal(ra: np.ndarray, dec: np.ndarray, latitude: float, longitude: float, sidereal: float) -> tuple[np.ndarray, np.ndarray]:
    """Altitude and azimuth in radians of stars in degrees, as ``sky.horizontal``."""
    hour, d, p = np.radians(sidereal + longitude - ra), np.radians(dec), math.radians(latitude)
    alt = np.arcsin(np.clip(math.sin(p) * np.sin(d) + math.cos(p) * np.cos(d) * np.cos(hour), -1, 1))
    return alt, np.arctan2(-np.sin(hour) * np.cos(d), np.sin(d) * math.cos(p) - np.cos(d) * np.cos(hour) * math.sin(p))


def project(alt: np.ndarray, az: np.ndarray, p: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels of directions (radians) under the six parameters; the tilt is in the directions."""
    r = p[3] / 2 * np.sin((np.pi / 2 - alt) / 2) * math.sqrt(2)
    a = az - np.radians(p[0])
    return np.stack([width / 2 + p[4] - r * np.sin(a), height / 2 - p[5] - r * np.cos(a)], axis=1)


def visible(frames: DataFrame, stars: DataFrame) -> DataFrame:
    """``frames`` with each of their stars above the least altitude: star, ra, dec, alt, az (degrees).

    Frames and stars meet by blocks of the catalogue.
    """
    blocks = 16
    dealt = stars.withColumn("block", F.pmod(F.xxhash64("star"), F.lit(blocks)).cast("int"))
    met = frames.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "block").drop("block")
    return met.withColumns(sky.horizontal(F.col("ra"), F.col("dec"), F.col("latitude"), F.col("longitude"), F.col("epoch"))).where(F.col("alt") > LEAST_ALTITUDE)


def coarse(seen: DataFrame, detections: DataFrame, step: float = AZIMUTH_STEP) -> DataFrame:
    """frame, candidate (azimuth, diameter, ox, oy, mirror), matched: by how many stars have a detection near.

    ``seen``: as of ``visible``, with width, height and the guessed diameter; ``detections``:
    frame, rid, rx, ry. A mirrored sky is tried without offsets only, to be told, not fitted.
    """
    choices = [(d, x, y, False) for d in DIAMETERS for x in OFFSETS for y in OFFSETS] + [(d, 0.0, 0.0, True) for d in DIAMETERS]
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("share"), F.lit(x).alias("ox"), F.lit(y).alias("oy"), F.lit(m).alias("mirror")) for d, x, y, m in choices]))
    turns = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(360 / step) - 1)), lambda i: i * step))
    rows = seen.withColumn("c", grid).select("frame", "star", "alt", "az", "width", "height", (F.col("diameter") * F.col("c.share")).alias("diameter"), "c.ox", "c.oy", "c.mirror", turns.alias("azimuth"))
    xy = sky.fisheye(F.col("alt"), F.col("az") - F.col("azimuth"), F.col("diameter"), 0.0, 0.0)
    x = F.col("width") / 2 + F.col("ox") + F.when(F.col("mirror"), -xy["x"]).otherwise(xy["x"])
    candidate = F.struct("azimuth", "diameter", "ox", "oy", "mirror")
    placed = rows.select("frame", F.struct(candidate.alias("candidate"), "star").alias("rid"), x.alias("rx"), (F.col("height") / 2 - F.col("oy") + xy["y"]).alias("ry"))
    largest = seen.agg(F.max("diameter")).first()[0]
    if largest is None:
        return seen.sparkSession.createDataFrame([], "frame bigint, candidate struct<azimuth:double,diameter:double,ox:double,oy:double,mirror:boolean>, matched bigint")
    # the detections, which are few, name the cells around them
    few = detections.select("frame", F.col("rid").alias("lid"), F.col("rx").alias("lx"), F.col("ry").alias("ly"))
    near = nearest_in_cells(few, placed, max(LEAST_RADIUS, MATCH_SHARE * largest), ("frame",))
    # a star counts once, however many detections are near it
    once = near.groupBy("frame", "rid").agg(F.lit(1).alias("hit"))
    return once.groupBy("frame", F.col("rid.candidate").alias("candidate")).agg(F.count("*").alias("matched"))


def _matched(at: np.ndarray, seen: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars and their detections, each one's nearest being the other, at most ``radius`` apart."""
    gap = ((at[:, None, :] - seen[None, :, :]) ** 2).sum(axis=2)
    best = gap.argmin(axis=1)
    stars = np.arange(len(at))
    ok = (gap[stars, best] <= radius**2) & (gap.argmin(axis=0)[best] == stars)
    return stars[ok], best[ok]


def refine(ra: np.ndarray, dec: np.ndarray, site: tuple[float, float, float], seen: np.ndarray, start: np.ndarray, width: int, height: int, rounds: int = 40) -> tuple[np.ndarray, float, int]:
    """Parameters, RMS and matched stars after damped least squares with a soft loss.

    Azimuth, diameter and offsets are free first, then the tilt as well. Each round matches the
    stars anew within a shrinking radius.
    """
    p = np.array(start, dtype=float)

    def placed(q: np.ndarray, pick=slice(None)) -> np.ndarray:
        alt, az = horizontal(ra[pick], dec[pick], site[0] + q[1], site[1] + q[2], site[2])
        at = project(alt, az, q, width, height)
        at[alt <= 0] = 1e9
        return at

    widths = np.array([0.01, 0.01, 0.01, 0.1, 0.1, 0.1])
    rms, matched = float("inf"), 0
    for k in range(rounds):
        free = [0, 3, 4, 5] if k < 8 else [0, 1, 2, 3, 4, 5]
        radius = max(RMS_FLOOR + 1, 1.5 * MATCH_SHARE * p[3] * 0.9**k)
        stars, found = _matched(placed(p), seen, radius)
        matched = len(stars)
        if matched < len(free) + 4:
            return p, float("inf"), matched
        at = placed(p, stars)
        gap = at - seen[found]
        rms = float(np.sqrt((gap**2).sum(axis=1).mean()))
        jac = np.stack([(placed(p + widths * (np.arange(6) == j), stars) - at) / widths[j] for j in free], axis=2)
        w = 1 / np.sqrt(1 + (gap**2).sum(axis=1) / (radius / 2) ** 2)
        a, b = (jac * w[:, None, None]).reshape(-1, len(free)), -(gap * w[:, None]).reshape(-1)
        scale = np.sqrt((a**2).sum(axis=0)) + 1e-9
        step, *_ = np.linalg.lstsq(np.vstack((a / scale, 1e-3 * np.eye(len(free)))), np.concatenate((b, np.zeros(len(free)))), rcond=None)
        p[free] += step / scale
        p[1:3] = np.clip(p[1:3], -MOST_TILT, MOST_TILT)
        if k > 25 and np.abs(step / scale).max() < 1e-5:
            break
    return p, rms, matched


def _fit_frame(key: tuple, stars: pd.DataFrame, starts: pd.DataFrame, seen: np.ndarray) -> tuple:
    """One frame's row of ``FIT``."""
    none = (key[0], False, "too_few_matches", *[None] * 6, None, 0)
    if not len(stars) or not len(starts) or not len(seen):
        return none
    top = starts.sort_values("matched", ascending=False)
    if bool(top.iloc[0]["mirror"]) and top.iloc[0]["matched"] >= LEAST_MATCHED:
        return (key[0], False, "chirality_mismatch", *[None] * 6, None, int(top.iloc[0]["matched"]))
    first = stars.iloc[0]
    site, size = (first.latitude, first.longitude, first.sidereal), (int(first.width), int(first.height))
    fits = [refine(stars["ra"].to_numpy(), stars["dec"].to_numpy(), site, seen, np.array([c.azimuth, 0.0, 0.0, c.diameter, c.ox, c.oy]), *size) for c in top[~top["mirror"]].itertuples()]
    if not fits:
        return none
    p, rms, matched = max(fits, key=lambda f: (f[2] >= LEAST_MATCHED and f[1] <= max(RMS_SHARE * f[0][3], RMS_FLOOR), f[2], -f[1]))
    good = rms <= max(RMS_SHARE * p[3], RMS_FLOOR)
    reason = None if good and matched >= LEAST_MATCHED else "no_convergence" if matched >= LEAST_MATCHED else "too_few_matches"
    return (key[0], reason is None, reason, float(p[0] % 360), *map(float, p[1:]), rms if np.isfinite(rms) else None, int(matched))


def solve(frames: DataFrame, stars: DataFrame, detections: DataFrame) -> DataFrame:
    """frame, success, reason, the six parameters, rms, matched: the lens of every frame.

    ``frames``: frame, latitude, longitude, epoch (seconds), width, height and a guessed
    diameter; ``stars``: star, ra, dec; ``detections``: frame, rid, rx, ry. A frame without
    stars or detections is no success; a mirrored sky is told as such.
    """
    seen = visible(frames, stars)
    scored = coarse(seen, detections).select("frame", "candidate.*", "matched")
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("frame", "mirror").orderBy(F.desc("matched"), "azimuth", "diameter", "ox", "oy"))).where(F.col("place") <= STARTS)
    rows = seen.select("frame", F.lit("star").alias("what"), F.struct("ra", "dec", "latitude", "longitude", sky.sidereal_degrees(F.col("epoch")).alias("sidereal"), "width", "height").alias("star"))
    rows = rows.unionByName(best.select("frame", F.lit("start").alias("what"), F.struct("azimuth", "diameter", "ox", "oy", "mirror", F.col("matched").cast("double").alias("matched")).alias("start")), allowMissingColumns=True)
    rows = rows.unionByName(detections.select("frame", F.lit("seen").alias("what"), F.struct("rx", "ry").alias("seen")), allowMissingColumns=True)
    rows = rows.unionByName(frames.select("frame", F.lit("frame").alias("what")), allowMissingColumns=True)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        of = lambda what: pd.DataFrame(part.loc[part["what"] == what, what].tolist())
        seen = of("seen")
        return pd.DataFrame([_fit_frame(key, of("star"), of("start"), seen[["rx", "ry"]].to_numpy(float) if len(seen) else np.empty((0, 2)))], columns=[x.split()[0] for x in FIT.split(", ")])

    return rows.groupBy("frame").applyInPandas(fit, FIT)
