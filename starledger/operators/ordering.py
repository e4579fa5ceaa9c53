"""Windows, state over ordered rows, sorts and top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: W2-W4's constants, fixed by the observatory's rules.
HISTORY, STACK_LEAST, STACK_SIGMAS = 6, 15, 3.0


ORDER = ("create_date", "id")


def with_previous(df: DataFrame, columns: list[str], by: str = "camera_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` with ``previous``: the columns of the row before, in order, of the same key.

    A key may hold a large share of all rows, so it is cut by day: the row before is looked up
    within the day, and for a day's first row among the last rows of all days, a small table.
    """
    kept = F.struct(*columns)
    days = df.withColumn("__day", F.to_date(order[0]))
    last = days.groupBy(by, "__day").agg(F.max_by(kept, F.struct(*order)).alias("__last"))
    before = last.select(by, "__day", F.lag("__last").over(Window.partitionBy(by).orderBy("__day")).alias("__before"))
    inner = Window.partitionBy(by, "__day").orderBy(*order)
    return days.join(before, [by, "__day"]).withColumn("previous", F.coalesce(F.lag(kept).over(inner), "__before")).drop("__day", "__before")


def lags(frames: DataFrame) -> DataFrame:
    """Seconds since the previous frame of the camera, and how much the frame took beyond its exposure."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = with_previous(frames.select("id", "camera_id", "create_date", "elapsed", "exposure"), ["create_date"])
    return rows.select("id", "camera_id", "create_date", ((micros("create_date") - micros("previous.create_date")) / 1e6).alias("period"), (F.col("elapsed") - F.col("exposure")).alias("delta"))


def placed(df: DataFrame, by: list[str], slots: list[Column], order: list[Column], name: str = "at") -> DataFrame:
    """``df`` with each row's number in order within its key, from 1.

    A key may hold a large share of all rows, so it is cut into slots that come in the same
    order: rows are numbered within a slot, and what the slots before hold is added, which
    is one small row a slot.
    """
    names = [f"__slot{i}" for i in range(len(slots))]
    rows = df.withColumns(dict(zip(names, slots, strict=True)))
    earlier = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, *names).count().select(*by, *names, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, *names).orderBy(*order))
    return rows.join(before, [*by, *names]).withColumn(name, F.col("__before") + within).drop(*names, "__before")


def with_run_up(df: DataFrame, by: str, most: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` cut by day, each day after the ``most`` rows of its key before it.

    Adds ``day`` and ``run_up``, which marks the rows that are there for a window's sake only.
    The last rows of a day stand in for it, so a key that holds a large share of all rows is
    no hot task.
    """
    rows = df.withColumn("day", F.to_date(order[0]))
    nth = F.row_number().over(Window.partitionBy(by, "day").orderBy(*[F.desc(c) for c in order]))
    ends = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(by, "day").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))).alias("end"))
    days = Window.partitionBy(by).orderBy("day")
    past = ends.select("day", F.flatten(F.collect_list("end").over(days.rowsBetween(-most, -1))).alias("past"))
    last = F.slice("past", F.greatest(F.size("past") - most + 1, F.lit(1)), most)
    tails = past.select("day", F.explode(last).alias("t")).select("t.row.*", "day", F.lit(True).alias("run_up"))
    return rows.withColumn("run_up", F.lit(False)).unionByName(tails)


def moving_average(frames: DataFrame, value: str, reset: Column, size: int = HISTORY) -> DataFrame:
    """Mean of the last ``size`` values since the last reset, null until there are as many.

    A reset row starts a new history that it belongs to. Resets are counted by day first.
    """
    rows = frames.withColumns({"__day": F.to_date("create_date"), "__reset": reset.cast("int")})
    days = rows.groupBy("camera_id", "__day").agg(F.sum("__reset").alias("n"))
    past = Window.partitionBy("camera_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("camera_id", "__day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("__before"))
    today = Window.partitionBy("camera_id", "__day").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.join(before, ["camera_id", "__day"]).withColumn("run", F.col("__before") + F.sum("__reset").over(today)).drop("__day", "__reset", "__before")
    w = Window.partitionBy("camera_id", "day", "run").orderBy(*ORDER).rowsBetween(-(size - 1), 0)
    means = with_run_up(runs, "camera_id", size - 1).withColumn("mean", F.when(F.count(value).over(w) == size, F.avg(value).over(w)))
    return means.where("not run_up").drop("day", "run_up")


def held(frames: DataFrame, reading: Column) -> DataFrame:
    """Id and reading: the last reading of the key up to each row, by day, as in ``with_previous``."""
    rows = frames.select("id", "camera_id", "create_date", F.to_date("create_date").alias("day"), reading.alias("reading"))
    ends = rows.where("reading is not null").groupBy("camera_id", "day").agg(F.max_by("reading", F.struct(*ORDER)).alias("end"))
    days = rows.select("camera_id", "day").distinct().join(ends, ["camera_id", "day"], "left")
    past = Window.partitionBy("camera_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("camera_id", "day", F.last("end", ignorenulls=True).over(past).alias("before"))
    today = Window.partitionBy("camera_id", "day").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, ["camera_id", "day"]).select("id", F.coalesce(F.last("reading", ignorenulls=True).over(today), "before").alias("reading"))


def by_batches(df: DataFrame, key: str, order: list[str], machine, schema: str) -> DataFrame:
    """A state machine over each key's rows in order, a batch of rows in memory at a time.

    ``machine()`` gives an object whose ``feed(row dict)`` returns the output row. Rows are
    dealt by key and sorted, so a key may have more rows than fit in memory.
    """
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if state is None or row[key] != current:
                    current, state = row[key], machine()
                out.append(state.feed(row))
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Exposure:
    """The controller's state. Until the target is found, a value within the deviation of it
    finds it, becomes the level to hold and starts an empty history; any other value moves the
    exposure. Then the target is lost when the mean of a full history is beyond the deviation
    of that level. Short exposures have the wider deviation and move half the way.
    """

    #: Below this exposure (seconds) it is bright day; deviation and scale of day and night.
    BRIGHT, DAY, NIGHT = 0.001, (20.0, 0.5), (10.0, 1.0)

    def __init__(self, target: float = 75.0, exposure: float = 1.0, shortest: float = 1e-5, longest: float = 60.0):
        self.target, self.exposure, self.shortest, self.longest = target, exposure, shortest, longest
        self.history: list[float] = []
        self.found, self.level = False, 0.0

    def step(self, adu: float) -> tuple[bool, float]:
        adu = adu if adu > 0 else 0.1
        deviation, scale = self.DAY if self.exposure < self.BRIGHT else self.NIGHT
        if not self.found:
            if abs(adu - self.target) <= deviation:
                self.found, self.level, self.history = True, adu, []
            else:
                moved = self.exposure - (self.exposure - self.exposure * (self.target / adu)) * scale
                self.exposure = min(self.longest, max(self.shortest, moved))
        else:
            self.history = [*self.history, adu][-HISTORY:]
            if len(self.history) == HISTORY and abs(sum(self.history) / HISTORY - self.level) > deviation:
                self.found = False
        return self.found, self.exposure

    def feed(self, row: dict) -> dict:
        found, exposure = self.step(row["adu"])
        return {"id": row["id"], "camera_id": row["camera_id"], "found": found, "exposure": exposure}


class Gate:
    """A value is taken if it lies within three standard deviations of the values taken so
    far, once there are fifteen; a value that is not taken never enters the history."""

    def __init__(self, least: int = STACK_LEAST, sigmas: float = STACK_SIGMAS):
        self.least, self.sigmas = least, sigmas
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def feed(self, row: dict) -> dict:
        v = row["adu"]
        taken = self.n < self.least or abs(v - self.mean) <= self.sigmas * (self.m2 / self.n) ** 0.5
        if taken:
            self.n += 1
            d = v - self.mean
            self.mean += d / self.n
            self.m2 += d * (v - self.mean)
        return {"id": row["id"], "camera_id": row["camera_id"], "taken": taken}


def transitions(frames: DataFrame, flag: str) -> DataFrame:
    """Rows at which a flag changes, with the number of the session that begins.

    Only the changes are numbered, which are few.
    """
    before = with_previous(frames, [flag])
    changes = before.where(F.col("previous").isNull() | (F.col(f"previous.{flag}") != F.col(flag)))
    w = Window.partitionBy("camera_id").orderBy("create_date", "id")
    return changes.withColumn("session", F.row_number().over(w)).select("id", "camera_id", "create_date", flag, "session")


def next_transition(changes: DataFrame) -> DataFrame:
    """When each session ends."""
    w = Window.partitionBy("camera_id").orderBy("create_date", "id")
    return changes.withColumn("ends", F.lead("create_date").over(w))


def running(frames: DataFrame) -> DataFrame:
    """The greatest value so far, and the frame of the least value so far.

    As in ``with_previous``: the days before a row come from one row a day.
    """
    days = frames.select("id", "camera_id", "create_date", "adu", F.to_date("create_date").alias("day"))
    dark = F.struct("adu", "id")
    ends = days.groupBy("camera_id", "day").agg(F.max("adu").alias("top"), F.min(dark).alias("dark"))
    past = Window.partitionBy("camera_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("camera_id", "day", F.max("top").over(past).alias("top"), F.min("dark").over(past).alias("dark"))
    w = Window.partitionBy("camera_id", "day").orderBy("create_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.join(before, ["camera_id", "day"]).select("id", "camera_id", "top", "dark", F.max("adu").over(w).alias("m"), F.min(dark).over(w).alias("d"))
    return rows.select("id", "camera_id", F.greatest("m", "top").alias("max_so_far"), F.least("d", "dark")["id"].alias("darkest_so_far"))


def age(df: DataFrame, time: str, as_of: Column, limit: int) -> DataFrame:
    """Whole seconds since ``time``, and DOWN beyond ``limit``."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col(time).cast("timestamp"))
    return df.withColumn("age", seconds).withColumn("status", F.when(seconds > limit, "DOWN").otherwise("UP"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def stratified(df: DataFrame, stratum: Column, order: list[Column], k: int) -> DataFrame:
    """K rows dealt round robin over strata, the best of each first."""
    ranked = df.withColumn("stratum", stratum)
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).where(F.col("place") <= k)
    return ranked.orderBy("place", "stratum").limit(k)


def exactly_one(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups with their count and whether there is exactly one row."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("one", F.col("n") == 1)
