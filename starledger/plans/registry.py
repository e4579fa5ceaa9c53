"""Names for queries, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starledger.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, each read when it is named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name) if name in tables.TABLES else tables.stored(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers ``f(tables)`` under its name; ``sql`` follows the views of the observatory tables."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            views = tables.VIEWS.replace("with ", "with recursive ", 1) if body.startswith("with recursive ") else tables.VIEWS
            inner = body.removeprefix("with ").removeprefix("recursive ")
            ORACLES[key] = f"{views},\n{inner}" if body.startswith("with ") else f"{views}\n{body}"
        return f

    return add
