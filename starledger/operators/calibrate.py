"""Estimates behind the repair of shifted frames (N37): clipping plateau and highlight blend.

Candidates of the search are exploded beside the samples and scored by aggregations: the median
error of each pair, so that a long pair weighs no more than a short one, then the mean over
pairs, then the least. Evidence that is too thin gives a reason instead of a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import MOST, exact

# The camera's own settings and the limits of the evidence.
SATURATION, HEADROOM, SNAP, PLATEAU_SHARE = 65_000, 534, 64, 0.9
STARTS = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
ENDS = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
LEAST_WIDTH, OWN_START, OWN_END, OWN_TOLERANCE = 0.10, 0.55, 0.75, 0.02
LEAST_TOTAL, LEAST_OF_PAIR, LEAST_REFERENCE, WORST_SCORE, BASE_STEPS, TOP = 1000, 50, 4096, 0.08, 800, 65_535.0


def saturation(cells: DataFrame, most: int = MOST) -> DataFrame:
    """threshold, plateau, clipped, reason: one row. ``cells``: pair, bad_g1, bad_g2.

    The plateau is a high quantile of the pairs' clipped green maxima, so that one hot pixel is
    no plateau; the threshold lies below it, or is the camera's own if that is near.
    """
    tops = cells.groupBy("pair").agg(F.max("bad_g1").alias("a"), F.max("bad_g2").alias("b")).select(F.explode(F.array("a", "b")).alias("top")).where(F.col("top") >= SATURATION)
    found = exact(tops.withColumn("all", F.lit(1)), ["all"], "top", [PLATEAU_SHARE], ["q"], most)
    plateau = F.bround("q").cast("int")
    lower = F.greatest(F.lit(1), plateau - HEADROOM)
    row = tops.agg(F.count("*").alias("clipped")).join(found, F.lit(True), "left")
    threshold = F.when(F.abs(lower - SATURATION) <= SNAP, SATURATION).otherwise(lower)
    return row.select(threshold.alias("threshold"), plateau.alias("plateau"), "clipped", F.when(F.col("clipped") == 0, "no green plateau: brighter pairs are needed").alias("reason"))


def blends() -> list[tuple[float, float, int, int]]:
    """start, end and their whole steps of every candidate that is wide enough."""
    step = lambda r: round((1.0 - (1.0 - r) ** 2 / 2.0) * BASE_STEPS)
    return [(a, b, step(a), step(b)) for a in STARTS for b in ENDS if b - a >= LEAST_WIDTH and step(a) < step(b)]


def highlight_scores(cells: DataFrame, gain: dict[str, float], threshold: int, most: int = MOST) -> DataFrame:
    """start, end, score, pairs, samples of every candidate.

    ``cells``: pair, bad_r, bad_g1, bad_g2, bad_b, ref_r, ref_g1, ref_g2, ref_b, stable. Cells
    count whose greens are both clipped while the reference is not; pairs with few of them do not.
    """
    ref_g = (F.col("ref_g1") + F.col("ref_g2")) / 2.0
    whole = {n: F.col(f"bad_{n}") / gain[n] for n in ("r", "g1", "g2", "b")}
    seen = cells.select(
        "pair", F.least(F.lit(TOP), whole["r"]).alias("r"), whole["g1"].alias("g1"), whole["g2"].alias("g2"), F.least(F.lit(TOP), whole["b"]).alias("b"), F.col("ref_r").cast("double").alias("rr"), ref_g.alias("rg"), F.col("ref_b").cast("double").alias("rb"),
        (F.col("stable") & (F.col("bad_g1") >= threshold) & (F.col("bad_g2") >= threshold)).alias("used"),
    )
    usable = F.col("used") & (F.greatest("r", "b") > 0) & (F.col("rg") >= LEAST_REFERENCE) & (F.greatest("rr", "rg", "rb") < threshold)
    good = seen.where(usable).withColumns({"high": F.greatest("r", "b"), "low": F.least("r", "b")})
    base = F.col("high") - (F.col("high") - F.col("low")) * (F.col("high") - F.col("low")) / (2.0 * F.col("high"))
    good = good.withColumn("base", base)
    sized = good.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_OF_PAIR)
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("start", "end", "from", "to"), c, strict=True)]) for c in blends()])).alias("c")
    tried = good.join(sized, "pair").select("*", each).select("pair", "n", "r", "b", "rr", "rg", "rb", "g1", "g2", "high", "base", "c.*")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("base") / F.col("high") * BASE_STEPS - F.col("from")) / (F.col("to") - F.col("from"))))
    target = F.col("base") + weight * (F.col("high") - F.col("base"))
    green = (F.greatest("g1", target) + F.greatest("g2", target)) / 2.0
    tried = tried.withColumn("g", green).withColumns({"total": F.col("r") + F.col("g") + F.col("b"), "all": F.col("rr") + F.col("rg") + F.col("rb")})
    off = lambda p, q: (F.col(p) / F.col("total") - F.col(q) / F.col("all")) * (F.col(p) / F.col("total") - F.col(q) / F.col("all"))
    error = F.sqrt(off("r", "rr") + off("g", "rg") + off("b", "rb"))
    medians = exact(tried, ["start", "end", "pair", "n"], error, [0.5], ["error"], most)
    return medians.groupBy("start", "end").agg(F.avg("error").alias("score"), F.count("*").alias("pairs"), F.sum("n").alias("samples"))


def highlight_blend(scores: DataFrame) -> DataFrame:
    """start, end, score, best_start, best_end, best_score, own, samples, reason: one row from ``highlight_scores``.

    The camera's own blend is kept (``own``) unless the best is better by more than its
    tolerance, as a smaller gain is more likely cloud than camera.
    """
    first = scores.agg(F.min(F.struct("score", "start", "end")).alias("b"), F.max(F.when((F.col("start") == OWN_START) & (F.col("end") == OWN_END), F.col("score"))).alias("own_score"), F.max("samples").alias("samples"))
    own = F.col("own_score") <= F.col("b.score") * (1 + OWN_TOLERANCE)
    row = first.select(
        F.when(own, OWN_START).otherwise(F.col("b.start")).alias("start"), F.when(own, OWN_END).otherwise(F.col("b.end")).alias("end"), F.when(own, F.col("own_score")).otherwise(F.col("b.score")).alias("score"),
        F.col("b.start").alias("best_start"), F.col("b.end").alias("best_end"), F.col("b.score").alias("best_score"), own.alias("own"), F.coalesce("samples", F.lit(0)).alias("samples"),
    )
    reason = F.when(F.col("samples") < LEAST_TOTAL, "too few clipped highlights: brighter pairs are needed").when(F.col("score") > WORST_SCORE, "no blend fits the highlights")
    return row.withColumn("reason", reason)
