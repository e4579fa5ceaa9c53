"""Exact quantiles of keys of any size.

A key with few rows is sorted in one task. A key with more is narrowed: a mergeable sketch, whose
error is a known share of the rows, gives bounds around each wanted rank; rows below are
counted, rows between are kept, and that is done again until few are left, which are ranked. So
no task holds a key's values, wherever they lie, and a value that a third of the rows have is
one row with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.sources.sinks import stored

#: Rows of a key that one task may sort.
MOST = 1_000_000
#: The sketch's ranks are right to one in so many rows.
ACCURACY = 1000


def _narrowed(by: list[str], values: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """by, rank, value: the value of each rank (from 0) of its key, by bounds ever closer. ``ranks``: by, n, rank."""
    key = [*by, "rank"]
    infinite = float("inf")
    bounds = ranks.select(*key, F.lit(-infinite).alias("low"), F.lit(infinite).alias("high"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("rows"))
    inside = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    grid = F.percentile_approx("value", [k / ACCURACY for k in range(ACCURACY + 1)], 4 * ACCURACY).alias("grid")
    before = None
    while True:
        share = lambda off: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("rank") - F.col("below")) / F.col("rows") + off / ACCURACY))
        sketch = values.join(bounds, by).where(inside).groupBy(*key).agg(grid).join(bounds, key)
        place = lambda share: F.element_at("grid", share.cast("int") + 1)
        close = sketch.select(*key, place(F.floor(share(-2.0) * ACCURACY)).alias("low"), place(F.ceil(share(2.0) * ACCURACY)).alias("high"))
        counts = values.join(close, by).groupBy(*key, "low", "high").agg(F.count_if(F.col("value") < F.col("low")).alias("below"), F.count_if(inside).alias("rows"), F.approx_count_distinct(F.when(inside, F.col("value"))).alias("distinct"))
        bounds = stored(counts, "bounds")
        size, rows = bounds.agg(F.max("distinct"), F.sum("rows")).first()
        if size <= most or rows == before:
            break
        before = rows
    held = values.join(bounds, by).where(inside).groupBy(*key, "below", "value").agg(F.count("*").alias("count"))
    running = F.sum("count").over(Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    upto = held.withColumn("upto", F.col("below") + running)
    return upto.where(F.col("upto") > F.col("rank")).groupBy(*key).agg(F.min("value").alias("value"))


def exact(df: DataFrame, by: list[str], value: Column | str, probabilities: list[float], names: list[str], most: int = MOST) -> DataFrame:
    """``by`` and one column for each probability: the quantile between the two nearest ranks, weighted by distance.

    Nulls do not count; a key with nulls only gives nulls. NaN is above every number.
    """
    value = F.col(value) if isinstance(value, str) else value
    # as one struct, so that a null key meets itself in joins
    rows, names_of, by = df.select(F.struct(*by).alias("key"), value.cast("double").alias("value")), by, ["key"]
    sizes = stored(rows.groupBy(*by).agg(F.count("value").alias("n")), "sizes")
    hot = sizes.where(F.col("n") > most)
    sorted_at_once = lambda part: part.groupBy(*by).agg(*[F.percentile("value", p).alias(n) for p, n in zip(probabilities, names, strict=True)])
    if hot.isEmpty():
        return sorted_at_once(rows).select(*[f"key.{n}" for n in names_of], *names)
    cold = sorted_at_once(rows.join(hot.select(*by), by, "left_anti"))
    values = rows.join(hot.select(*by), by, "left_semi").where("value is not null")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)).cast("bigint"), F.ceil(place(p)).cast("bigint")) for p in probabilities])))
    found = stored(_narrowed(by, values, hot.select(*by, "n", F.explode(wanted).alias("rank")), most), "ranks")
    picked = hot.join(found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")), by)
    at = lambda r: F.element_at("at", r.cast("bigint"))
    part = lambda p: place(p) - F.floor(place(p))
    mixed = [(at(F.floor(place(p))) * (1 - part(p)) + at(F.ceil(place(p))) * part(p)).alias(n) for p, n in zip(probabilities, names, strict=True)]
    return cold.union(picked.select(*by, *mixed)).select(*[f"key.{n}" for n in names_of], *names)
