"""Sinks: appended rows, status files, snapshots, and tables that cut a lineage (K1-K6)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a session on one machine gets a temporary one; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="starledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps start from files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_rows(df: DataFrame, path: str, by: tuple[str, ...] = ("camera_id", "day_date")) -> None:
    """K1: a batch of rows, in folders by camera and day so that later scans skip the rest."""
    df.repartition(*by).sortWithinPartitions("create_date").write.mode("append").partitionBy(*by).parquet(path)


def status_json(df: DataFrame, path: str) -> None:
    """K2: the status document of each camera, replaced as a whole."""
    df.coalesce(1).write.mode("overwrite").json(path)


def topic_values(df: DataFrame, key: str, prefix: str = "sky") -> DataFrame:
    """K3: one (topic, payload) a value of the row, for a message broker's sink."""
    columns = [c for c in df.columns if c != key]
    pairs = F.array(*[F.struct(F.concat_ws("/", F.lit(prefix), F.col(key).cast("string"), F.lit(c)).alias("topic"), F.col(c).cast("string").alias("payload")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("payload is not null")


def events(df: DataFrame, kind: str, at: str) -> DataFrame:
    """K4: rows as event documents: event, timestamp, data."""
    data = F.struct(*[c for c in df.columns if c != at])
    return df.select(F.to_json(F.struct(F.lit(kind).alias("event"), F.unix_timestamp(F.col(at).cast("timestamp")).alias("timestamp"), data.alias("data"))).alias("value"))


def snapshot(df: DataFrame, path: str) -> None:
    """K5: a compressed copy of a table."""
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def expired_snapshots(snapshots: DataFrame, as_of, days: int) -> DataFrame:
    """K5: snapshots (path, made) older than ``days``."""
    return snapshots.where(F.col("made") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
