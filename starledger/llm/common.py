"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a kernel handles at once, about; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of a cut of an Arrow batch.
CUT_BYTES = 1 << 21
#: Rows of a narrow table that a task writes.
TASK_ROWS = 1 << 17
#: Rows of a stored narrow table up to which a join may broadcast it.
BROADCAST_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a session on one machine (tests) gets a temporary folder of its own; a
    cluster has no folder that a driver could make up, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="starledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back, and the path.

    Cuts the lineage: what follows survives lost executors without recomputing ``df``.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a narrow table of at most ``rows`` rows, in no more tasks than these need: of a small table no hundreds of files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a stored narrow table that may grow with the input, as a side of a join: never broadcast beyond ``BROADCAST_ROWS`` rows.

    Spark goes by the bytes of files, which in the driver become many times as much.
    """
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored_at`` wrote, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name clashes, has a dot or differs by case only.

    ``toDF(*df.columns)`` gives the names back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def clash_free(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name, so that extra columns never clash."""
    flat = by_position(df)
    return flat.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def filtered(df: DataFrame, column: str, keep: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows of ``df`` whose text in ``column`` is to be kept, with all columns as they were."""
    flat, at = by_position(df), df.columns.index(column)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(keep(texts(b.column(at))), pa.bool_()))

    return per_batch(flat, kernel, flat.schema).toDF(*df.columns)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids fall in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows of about ``CUT_BYTES``, so that Python copies stay small."""
    for b in batches:
        step = max(1, b.num_rows * CUT_BYTES // max(1, b.nbytes))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def per_batch(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``kernel`` over cuts of Arrow batches, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cuts(batches):
            if (out := kernel(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def chunks(values: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of about ``most`` bytes each, in order."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


def word_table(separators: bytes, lower: bool = True) -> bytes:
    """A 256-byte table for ``bytes.translate``: separators become spaces, A-Z lower case."""
    out = bytearray(range(256))
    for c in separators:
        out[c] = 32
    if lower:  # lower-casing comes first, so A-Z are no separators
        for c in range(65, 91):
            out[c] = c + 32
    return bytes(out)


def starts_of(counts: list[int] | np.ndarray) -> np.ndarray:
    """Where each group begins if groups of these sizes lie one after another."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out
