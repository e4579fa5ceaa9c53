"""Predicates and projections over asset tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import placed


def optional(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All the conditions that were given."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def available(local: bool) -> Column | None:
    """With ``local`` false only assets that lie elsewhere too."""
    return None if local else F.col("remote_url").isNotNull() | F.col("s3_key").isNotNull()


def between(column: str, low, high, ends: str = "[]") -> Column:
    """A range whose ends are each open or closed."""
    c = F.col(column)
    above = c >= F.lit(low) if ends[0] == "[" else c > F.lit(low)
    return above & (c <= F.lit(high) if ends[1] == "]" else c < F.lit(high))


def older_than(column: str, as_of, days: int) -> Column:
    """P5: retention; ``as_of`` is given, never the clock."""
    return F.col(column) < F.date_sub(F.lit(as_of), days)


def json_in(column: str, path: str, values: Iterable[str]) -> Column:
    """Membership of a JSON value read as text."""
    return F.get_json_object(column, path).isin(*values)


def json_flag(column: str, path: str) -> Column:
    """A JSON value read as a boolean."""
    return F.get_json_object(column, path).cast("boolean")


def every_nth(df: DataFrame, n: int, order: list[Column], by: list[str], slots: list[Column]) -> DataFrame:
    """Each n-th row of a group in order; ``slots`` cut the order, as in ``placed``."""
    return placed(df, by, slots, order).where(F.col("at") % n == 0).drop("at")


def relative_path(filename: str | Column, root: str) -> Column:
    """The path below ``root``; paths elsewhere and relative ones stay."""
    c = F.col(filename) if isinstance(filename, str) else filename
    prefix = root.rstrip("/") + "/"
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def asset_url(root: str, s3_prefix: str, local: bool) -> Column:
    """Remote before object store before local; local if nothing else is known."""
    here = F.concat(F.lit("images/"), relative_path("filename", root))
    if local:
        return here
    return F.coalesce(F.col("remote_url"), F.concat(F.lit(s3_prefix + "/"), F.col("s3_key")), here)


def date_part_or(column: str, derived: Column) -> Column:
    """The stored part, or what it derives from where it was never filled."""
    return F.coalesce(F.col(column), derived)


def all_or_defaults(columns: dict[str, object]) -> list[Column]:
    """The columns, or all their defaults if any of them is null."""
    whole = None
    for c in columns:
        known = F.col(c).isNotNull()
        whole = known if whole is None else whole & known
    return [F.when(whole, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in columns.items()]


def with_date_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day and hour beside a timestamp."""
    return df.withColumns({f"{column}_{p}": getattr(F, f)(column) for p, f in (("year", "year"), ("month", "month"), ("day", "dayofmonth"), ("hour", "hour"))})


def without_keys_of(document: Column, keys: Iterable[str]) -> Column:
    """A JSON object as a map without some keys."""
    held = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(F.from_json(document, "map<string,string>"), lambda k, _: ~F.array_contains(held, k))
