"""Smaller operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starledger.sources.sinks import stored

from .ordering import by_batches, with_run_up


def lightning(polls: DataFrame, size: int) -> DataFrame:
    """Distances, energies, disturbers and noise of the ``size`` polls before each poll.

    ``polls``: id, camera_id, create_date, distances and energies (arrays), disturbers, noise.
    Each poll is reduced to least, greatest, sum and count first, so the window moves over
    numbers, not lists.
    """
    w = Window.partitionBy("camera_id", "day").orderBy("create_date", "id").rowsBetween(-size, -1)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, d: a + d)
    parts = [x for c, p in (("distances", "d"), ("energies", "e")) for x in (F.array_min(c).alias(f"{p}_lo"), F.array_max(c).alias(f"{p}_hi"), total(c).alias(f"{p}_sum"), F.size(c).alias(f"{p}_n"))]
    small = with_run_up(polls.select("id", "camera_id", "create_date", *parts, "disturbers", "noise"), "camera_id", size)
    of = lambda p, name: [F.min(f"{p}_lo").over(w).alias(f"min_{name}"), F.max(f"{p}_hi").over(w).alias(f"max_{name}"), (F.sum(f"{p}_sum").over(w) / F.nullif(F.sum(f"{p}_n").over(w), F.lit(0))).alias(f"mean_{name}")]
    counts = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("disturbers", "noise")]
    return small.select("id", *of("d", "distance"), *of("e", "energy"), F.coalesce(F.sum("d_n").over(w), F.lit(0)).alias("strikes"), *counts, "run_up").where("not run_up").drop("run_up")


def named_sensors(readings: DataFrame, names: DataFrame) -> DataFrame:
    """Id, name, unit and value of every slot that has a name; zeros only where they mean something.

    ``names``: slot, name, unit, zeros; a table of at most a few hundred slots.
    """
    spread = readings.select("id", F.posexplode("values").alias("slot", "value"))
    named = spread.join(F.broadcast(names), "slot").where((F.col("value") != 0) | F.col("zeros"))
    return named.select("id", "name", "unit", (F.bround(F.col("value") * 100) / 100).alias("value"))


def weather(documents: DataFrame) -> DataFrame:
    """Nested parts with zero where they are missing, and the first of a list."""
    doc = documents.select("id", "doc", F.from_json("doc", "wind struct<speed:double>, rain struct<h1:double>").alias("d"))
    first = F.get_json_object("doc", "$.k[0].Value.ActualValue").cast("double")
    return doc.select("id", F.coalesce("d.wind.speed", F.lit(0.0)).alias("wind"), F.coalesce("d.rain.h1", F.lit(0.0)).alias("rain"), first.alias("first_value"))


class Budget:
    """Files are taken in order while there is room; one that does not fit is passed over."""

    def __init__(self, files: int, size: int):
        self.files, self.size = files, size

    def feed(self, row: dict) -> dict:
        taken = self.files > 0 and row["file_size"] <= self.size
        if taken:
            self.files -= 1
            self.size -= row["file_size"]
        return {"id": row["id"], "camera_id": row["camera_id"], "taken": taken, "seed": row["seed"]}


def exposure_seeds(rows: DataFrame, levels: int, tolerance: float) -> DataFrame:
    """(camera_id, seeds): up to ``levels`` rows of each camera of exposures that differ.

    Newest first, a row is a seed if its exposure is close to no seed's before it: one
    aggregation a level, of which a key's rows give one row each.
    """
    close = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    seeds = rows.select("camera_id").distinct().withColumn("seeds", F.array().cast("array<struct<id:bigint,exposure:double>>"))
    for _ in range(levels):
        left = rows.join(seeds, "camera_id").where(~F.exists("seeds", lambda s: close(F.col("exposure"), s["exposure"])))
        newest = left.groupBy("camera_id").agg(F.max_by(F.struct(F.col("id").cast("bigint").alias("id"), F.col("exposure").cast("double").alias("exposure")), F.struct("create_date", -F.col("id"))).alias("next"))
        seeds = stored(seeds.join(newest, "camera_id", "left").select("camera_id", F.when(F.col("next").isNull(), F.col("seeds")).otherwise(F.array_append("seeds", F.col("next"))).alias("seeds")), "seeds")
    return seeds


def within_budget(rows: DataFrame, files: int, size: int, levels: int, tolerance: float) -> DataFrame:
    """By camera the seeds of the exposure levels first, then all others newest first; the state is the room left."""
    seeds = exposure_seeds(rows, levels, tolerance)
    dealt = rows.join(seeds, "camera_id").withColumns({"age": -F.unix_micros(F.col("create_date").cast("timestamp")), "seed": F.exists("seeds", lambda s: s["id"] == F.col("id"))})
    order = dealt.select("id", "camera_id", "file_size", "seed", (~F.col("seed")).alias("later"), "age")
    return by_batches(order, "camera_id", ["later", "age", "id"], partial(Budget, files, size), "id bigint, camera_id int, taken boolean, seed boolean").where("taken")
