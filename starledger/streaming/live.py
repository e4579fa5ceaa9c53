"""The observatory's running loops on Structured Streaming (Q1-Q12)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from starledger.operators.ordering import Exposure
from starledger.sources import tables
from starledger.sources.sinks import shared_dir

#: Rows of a camera for which the controller has Python objects at once.
STEP_ROWS = 1 << 16


def frames(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The frame table, a file or a folder of files, as a stream; event time becomes a timestamp with zone, as watermarks ask for."""
    source, columns = tables.TABLES["frames"]
    schema = tables.stored(spark, sf_dir, source).schema
    # a file, or the files of a folder of that name
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{source}.parquet*")
    return rows.selectExpr(*[f"{both} as {c}" for c, (both, _) in columns.items()]).withColumn("create_date", F.col("create_date").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what its sink holds.

    The sink's files and the checkpoint lie in the shared folder; a run that is cut off goes on
    from the checkpoint, and the file sink takes each batch once.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def in_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Q1: what each micro-batch gives of a batch pipeline; a batch that runs again replaces its own rows.

    Rows of all batches come back, so what spans batches is to be merged by the caller.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(lambda df, n: step(df).write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def night_parts(batch: DataFrame) -> DataFrame:
    """Q1: a batch's part of each night, in a form that parts of one night can be added up in."""
    return batch.where(~F.col("exclude")).groupBy("camera_id", "day_date", "night").agg(F.count("*").alias("frames"), F.max("stars").alias("max_stars"), F.sum("sqm").alias("sum_sqm"), F.count("sqm").alias("n_sqm"))


def nights(parts: DataFrame) -> DataFrame:
    """Q1: the nights of all batches."""
    merged = parts.groupBy("camera_id", "day_date", "night").agg(F.sum("frames").alias("frames"), F.max("max_stars").alias("max_stars"), (F.sum("sum_sqm") / F.nullif(F.sum("n_sqm"), F.lit(0))).alias("avg_sqm"))
    return merged.select("camera_id", "day_date", "night", "frames", "max_stars", "avg_sqm")


def tumbling(stream: DataFrame, minutes: int, late: str, columns: list[str]) -> DataFrame:
    """Q2: means of closed windows by camera; rows later than ``late`` are dropped."""
    return _windowed(stream, F.window("create_date", f"{minutes} minutes"), late, columns)


def sliding(stream: DataFrame, minutes: int, every: int, late: str, columns: list[str]) -> DataFrame:
    """Q3."""
    return _windowed(stream, F.window("create_date", f"{minutes} minutes", f"{every} minutes"), late, columns)


def _windowed(stream: DataFrame, window, late: str, columns: list[str]) -> DataFrame:
    means = stream.withWatermark("create_date", late).groupBy("camera_id", window.alias("w")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    return means.select("camera_id", F.col("w.start").alias("start"), "n", *columns)


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Q5: runs of frames of a camera without a longer gap."""
    found = stream.withWatermark("create_date", late).groupBy("camera_id", F.session_window("create_date", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("camera_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Q11: the first message of each key within the watermark's delay."""
    return stream.withWatermark("create_date", late).dropDuplicatesWithinWatermark(keys)


def fresh(stream: DataFrame, most_seconds: int) -> DataFrame:
    """Q9: rows whose sender's clock is near their arrival."""
    return stream.where(F.abs(F.unix_timestamp("received") - F.unix_timestamp("create_date")) <= most_seconds)


def skewed_clocks(rows: DataFrame, as_of) -> DataFrame:
    """Q10: rows from the future."""
    return rows.where(F.col("create_date") > as_of)


def due(last: DataFrame, periods: dict[str, int], as_of) -> DataFrame:
    """Q12: each row of ``last`` (with the time of the last fetch) by source: when it is due again, and whether it is now."""
    sources = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.lit(s).alias("period")) for n, s in sorted(periods.items())]))
    rows = last.withColumn("s", sources).select("*", "s.source", F.col("last").alias("__last"), "s.period")
    return rows.withColumn("due", F.expr("__last + make_dt_interval(0, 0, 0, period)")).withColumn("refresh", as_of >= F.col("due")).drop("s", "__last")


def _by_camera(stream: DataFrame, step, output: str, state: str) -> DataFrame:
    return stream.groupBy("camera_id").applyInPandasWithState(step, output, state, "append", GroupStateTimeout.NoTimeout)


def exposures(stream: DataFrame) -> DataFrame:
    """The controller over a stream; its state is six values, a flag, a level and an exposure.

    Rows of a micro-batch are ordered by time; the batches come in order. Of a camera's rows in
    a batch three numbers each are held, and Python's objects of ``STEP_ROWS`` only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times, values = (np.concatenate(x) for x in zip(*[(b["id"].to_numpy(), b["t"].to_numpy(), b["adu"].to_numpy()) for b in batches], strict=True))
        order = np.lexsort((ids, times))
        del times
        machine = Exposure()
        if state.exists:
            history, machine.found, machine.level, machine.exposure = state.get
            machine.history = list(history)
        for lo in range(0, len(order), STEP_ROWS):
            at = order[lo : lo + STEP_ROWS]
            found, exposure = zip(*map(machine.step, values[at].tolist()), strict=True)
            yield pd.DataFrame({"id": ids[at], "camera_id": key[0], "found": found, "exposure": exposure})
        state.update((machine.history, machine.found, machine.level, machine.exposure))

    return _by_camera(stream.select("id", "camera_id", F.unix_micros("create_date").alias("t"), "adu"), step, "id bigint, camera_id int, found boolean, exposure double", "history array<double>, found boolean, level double, exposure double")


def notifications(stream: DataFrame, seconds: int) -> DataFrame:
    """Q8, U8: the first note of a category, then the first after it has expired."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        until = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples():
            if until is None or r.t >= until:
                until = int(r.t) + seconds
                out.append((r.id,))
        state.update((until,))
        yield pd.DataFrame(out, columns=["id"], dtype="int64")

    rows = stream.select("id", "camera_id", "event_type", F.unix_timestamp("create_date").alias("t"))
    return rows.groupBy("camera_id", "event_type").applyInPandasWithState(step, "id bigint", "until bigint", "append", GroupStateTimeout.NoTimeout)


def last_columns(stream: DataFrame, most: int) -> DataFrame:
    """After each batch with rows of a camera the newest ``most`` values of its buffer, oldest first, with the number of that state.

    What is held of a batch is never more than the buffer and one Arrow batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, n = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        held = pd.DataFrame({"t": times, "id": ids}, dtype="int64")
        for b in batches:
            held = pd.concat([held, b[["t", "id"]].astype("int64")]).sort_values(["t", "id"]).tail(most)
        times, ids = held["t"].tolist(), held["id"].tolist()
        state.update((times, ids, n + 1))
        yield pd.DataFrame({"camera_id": [key[0]], "ids": [ids], "n": [n + 1]})

    rows = stream.select("id", "camera_id", F.unix_micros("create_date").alias("t"))
    return _by_camera(rows, step, "camera_id int, ids array<bigint>, n bigint", "times array<bigint>, ids array<bigint>, n bigint")


def newest_state(states: DataFrame) -> DataFrame:
    """Q6: each camera's last state."""
    return states.groupBy("camera_id").agg(F.max_by("ids", "n").alias("ids"))
