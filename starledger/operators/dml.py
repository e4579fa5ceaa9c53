"""Changes to tables as snapshot to snapshot."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import by_batches, with_previous


def union_tagged(tables: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """Tables one after another with their name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in tables.items()])


def upsert(old: DataFrame, new: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last new row of a key takes the old row's place; keys not met before are added."""
    rest = [c for c in old.columns if c not in by]
    both = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    return both.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("new", *order)).alias("row")).select(*by, *[F.col(f"row.{c}").alias(c) for c in rest])


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups named in ``new`` are replaced whole, the others stay."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def insert_or_reject(old: DataFrame, new: DataFrame, by: list[str], order: str, overwrite: bool) -> DataFrame:
    """U4, K6: per key: inserted, overwritten or rejected; doing it twice changes nothing more.

    Of new rows with one key the first by ``order`` is inserted if the key is not there yet; it
    is there for the others.
    """
    known = old.select(*by).distinct().withColumn("known", F.lit(True))
    first = new.groupBy(*by).agg(F.min(order).alias("first"))
    state = first.join(known, by, "left")
    said = F.when(F.col("known").isNull() & (F.col(order) == F.col("first")), "inserted").otherwise("overwritten" if overwrite else "rejected")
    return new.join(state, by, "left").withColumn("outcome", said).drop("known", "first")


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true, the unknown ones included."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def rewrite(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """A column set to a value where a condition holds."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


class Suppression:
    """The time until which a key's notes stay hidden."""

    def __init__(self, seconds: int):
        self.seconds, self.until = seconds, None

    def feed(self, row: dict) -> dict:
        shown = self.until is None or row["t"] >= self.until
        if shown:
            self.until = row["t"] + self.seconds
        return {"id": row["id"], "shown": shown}


def suppressed(notes: DataFrame, by: list[str], time: str, seconds: int) -> DataFrame:
    """U8, Q8: ids of the notes that are shown: the first of a key, then the first after it expired.

    A gap of at least the interval always starts anew, so notes are cut into islands at such
    gaps, the islands are dealt out, and each is read once in order with one number of state.
    Gaps are found, and islands named by the time they begin, day by day, so a key that holds
    a large share of all notes is no hot task until its notes leave no gap.
    """
    keyed = notes.select("id", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]).alias("key"), F.col(time).alias("t"), F.timestamp_seconds(time).alias("at"))
    rows = with_previous(keyed, ["t"], "key", ("at", "id"))
    opens = F.when(F.col("previous").isNull() | (F.col("t") - F.col("previous.t") >= seconds), F.col("t"))
    begun = rows.select("id", "key", "t", "at", F.to_date("at").alias("day"), opens.alias("opens"))
    days = begun.groupBy("key", "day").agg(F.max("opens").alias("opened"))
    past = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("key", "day", F.max("opened").over(past).alias("before"))
    today = Window.partitionBy("key", "day").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    islands = begun.join(before, ["key", "day"]).select("id", "t", F.concat_ws("/", "key", F.coalesce(F.max("opens").over(today), "before").cast("string")).alias("island"))
    return by_batches(islands, "island", ["t", "id"], partial(Suppression, seconds), "id bigint, shown boolean").where("shown").select("id")


def cascade(parents: DataFrame, deleted: Column, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """The children that stay when the parents that meet a condition go.

    A child that another parent still names stays.
    """
    going = parents.where(deleted).select(F.col(key).alias(child_key))
    staying = parents.where(~deleted).select(F.col(key).alias(child_key))
    return children.join(going.join(staying, child_key, "left_anti"), child_key, "left_anti")


def fill_missing(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Null columns filled from what they derive from."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in derived.items()})
