"""Aggregations over frames and assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.sources.sinks import stored

from .filters import all_or_defaults
from .quantiles import MOST, exact

NIGHT = ["camera_id", "day_date", "night"]
NIGHT_DEFAULTS = {"max_kpindex": 0.0, "max_ovation_max": 0, "max_smoke_rating": -1, "max_stars": 0, "avg_stars": 0.0, "max_moonphase": -1.0, "avg_sqm": 0.0}


def trailing_stats(frames: DataFrame, column: str, as_of: Column, minutes: int) -> DataFrame:
    """A1, A2: max, min, avg by camera over the minutes before ``as_of`` (open at the start)."""
    recent = frames.where((F.col("create_date") > as_of - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("create_date") <= as_of))
    return recent.groupBy("camera_id").agg(*[f(column).alias(f"{n}_{column}") for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))])


def night_rollup(frames: DataFrame) -> DataFrame:
    """A3: one row a camera, day and half; the camera table is not joined, none of it is used."""
    return (
        frames.where(~F.col("exclude"))
        .groupBy(*NIGHT)
        .agg(
            F.count("*").alias("frames"), F.max("kpindex").alias("max_kpindex"), F.max("ovation_max").alias("max_ovation_max"), F.max("smoke_rating").alias("max_smoke_rating"),
            F.max("stars").alias("max_stars"), F.avg("stars").alias("avg_stars"), F.max("moonphase").alias("max_moonphase"), F.avg("sqm").alias("avg_sqm"),
        )
    )


def night_rollup_defaults(frames: DataFrame) -> DataFrame:
    """A3 with P19: one missing value puts all of them to their defaults."""
    return night_rollup(frames).select(*NIGHT, *all_or_defaults(NIGHT_DEFAULTS))


def paired_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A4: rows a day, by table and half of the day, 0 where there are none.

    One pass over the union and one aggregation, where a full outer join of counts would be two.
    """
    tagged = reduce(DataFrame.unionByName, [df.select("day_date", "night").withColumn("kind", F.lit(k)) for k, df in tables.items()])
    counts = [F.count_if((F.col("kind") == k) & (F.col("night") == n)).alias(f"{k}_{'night' if n else 'day'}") for k in tables for n in (False, True)]
    return tagged.groupBy("day_date").agg(*counts)


def epoch_buckets(df: DataFrame, epoch: str, seconds: int, channels: list[str]) -> DataFrame:
    """A5: means of the channels by ``floor(epoch / seconds)``."""
    return df.groupBy(F.floor(F.col(epoch) / seconds).cast("bigint").alias("bucket")).agg(*[F.avg(c).alias(c) for c in channels])


def drill_down(df: DataFrame, parts: dict[str, Column], *conditions: Column) -> DataFrame:
    """The distinct values of date parts, those without a value left out."""
    for c in conditions:
        df = df.where(c)
    found = df.select(*[c.alias(n) for n, c in parts.items()]).distinct()
    return found.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in parts]))


def upload_matrix(tables: dict[str, DataFrame], flags: list[str]) -> DataFrame:
    """A10: by table, how many rows each way has and lacks."""
    parts = []
    for name, df in tables.items():
        known = [F.col(f) if f in df.columns else F.lit(None).cast("boolean") for f in flags]
        parts.append(df.select(F.lit(name).alias("kind"), *[c.alias(f) for c, f in zip(known, flags, strict=True)]))
    counts = [x for f in flags for x in (F.count_if(F.col(f)).alias(f"{f}_done"), F.count_if(~F.col(f)).alias(f"{f}_missing"))]
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count("*").alias("n_rows"), *counts)


def usage(assets: DataFrame, kinds: list[str]) -> DataFrame:
    """Bytes and files by day, half and kind, with the day's total over both halves."""
    sums = [x for k in kinds for x in (F.sum(F.when(F.col("kind") == k, F.col("file_size"))).alias(f"{k}_bytes"), F.count_if(F.col("kind") == k).alias(f"{k}_files"))]
    return assets.rollup("day_date", "night").agg(F.sum("file_size").alias("total_bytes"), *sums, F.grouping_id().alias("level")).where("level < 3")


def bucket_means(frames: DataFrame, minutes: int, columns: list[str]) -> DataFrame:
    """Tumbling means by camera."""
    return frames.groupBy("camera_id", F.window("create_date", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).select("camera_id", F.col("w.start").alias("start"), "n", *columns)


def mean_of_bucket_means(buckets: DataFrame, columns: list[str]) -> DataFrame:
    """Buckets count alike however many frames they hold."""
    return buckets.groupBy("camera_id").agg(*[F.avg(c).alias(c) for c in columns])


def latest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the last row of each group; combines on the map side, no sort."""
    got = df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    return got.select(*by, "last.*")


def recent_means(feed: DataFrame, as_of: Column, minutes: int, values: list[str], source: str) -> DataFrame:
    """Means of the last minutes of one source; rows with a missing value do not count."""
    rows = feed.where((F.col("ts") > as_of - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") <= as_of) & (F.col("source") == source))
    for v in values:
        rows = rows.where(F.col(v).isNotNull())
    return rows.agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def index_regression(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Least squares of a value on its place in the group; both coefficients, and the last value."""
    placed = df.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return placed.groupBy(*by).agg(F.regr_slope(value, "at").alias("slope"), F.regr_intercept(value, "at").alias("intercept"), F.max_by(value, "at").alias("last"))


def robust(df: DataFrame, by: list[str], value: str, low: float = 0.1, high: float = 0.9, most: int = MOST) -> DataFrame:
    """Median, median absolute deviation, median between two quantiles, relative deviation; a key of more than ``most`` rows is no one task."""
    first = stored(exact(df, by, value, [0.5, low, high], ["median", "q_low", "q_high"], most), "quantiles")
    joined = df.select(*by, value).join(first, by)
    inside = F.when((F.col(value) >= F.col("q_low")) & (F.col(value) <= F.col("q_high")), F.col(value))
    away = exact(joined, by, F.abs(F.col(value) - F.col("median")), [0.5], ["mad"], most)
    trimmed = exact(joined, by, inside, [0.5], ["trimmed_median"], most)
    second = first.select(*by, "median").join(away, by).join(trimmed, by)
    return second.withColumn("relative_mad", F.when(F.col("median") != 0, F.col("mad") / F.abs("median")))


def class_ranges(df: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """Each metric's range in both classes, and whether a threshold parts them."""
    ends = [x for m in metrics for x in (F.min(F.when(~F.col(label), F.col(m))).alias(f"good_min_{m}"), F.max(F.when(~F.col(label), F.col(m))).alias(f"good_max_{m}"), F.min(F.when(F.col(label), F.col(m))).alias(f"bad_min_{m}"), F.max(F.when(F.col(label), F.col(m))).alias(f"bad_max_{m}"))]
    wide = df.agg(*ends)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{e}_{m}").alias(e) for e in ("good_min", "good_max", "bad_min", "bad_max")]) for m in metrics])).alias("r")
    parted = F.col("good_max") < F.col("bad_min")
    return wide.select(rows).select("r.*").withColumn("parted", parted).withColumn("midpoint", F.when(parted, (F.col("good_max") + F.col("bad_min")) / 2))


def two_means(df: DataFrame, columns: list[str], rounds: int = 50) -> tuple[dict[str, float], dict[str, float]]:
    """Two centres in standardised log space, from the rows of least and greatest score.

    Every round is one aggregation of the stored logarithms; only the two centres come to the driver.
    """
    logs = df.select(*[F.ln(c).alias(c) for c in columns])
    spread = logs.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z = stored(logs.select(*[((F.col(c) - spread[f"m_{c}"]) / (spread[f"s_{c}"] or 1.0)).alias(c) for c in columns]), "logs")
    score = reduce(Column.__add__, [F.col(c) for c in columns])
    ends = z.agg(F.min_by(F.struct(*columns), F.struct(score, *columns)).alias("low"), F.max_by(F.struct(*columns), F.struct(score, *columns)).alias("high")).first()
    centres = [ends.low.asDict(), ends.high.asDict()]
    for _ in range(rounds):
        far = [reduce(Column.__add__, [(F.col(c) - k[c]) ** 2 for c in columns]) for k in centres]
        got = {r.side: r for r in z.groupBy((far[1] < far[0]).alias("side")).agg(*[F.avg(c).alias(c) for c in columns]).collect()}
        new = [{c: got[s][c] for c in columns} if s in got else centres[i] for i, s in enumerate((False, True))]
        if new == centres:
            break
        centres = new
    back = lambda k: {c: float(2.718281828459045 ** (k[c] * (spread[f"s_{c}"] or 1.0) + spread[f"m_{c}"])) for c in columns}
    return back(centres[0]), back(centres[1])


def reasons(df: DataFrame, gates: list[tuple[str, Column]], otherwise: str = "used") -> Column:
    """The first gate that a row fails."""
    said = F.lit(otherwise)
    for name, failed in reversed(gates):
        said = F.when(failed, name).otherwise(said)
    return said
