"""Connected components of a graph of links, contracted in the tasks before each exchange."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, stored_at

#: Links that a task contracts at once, which bounds its memory.
CONTRACTED = 1 << 17


def contracted(u: list, v: list) -> tuple[list, list]:
    """The links of two lists as stars: (least node, other node) for each component of theirs."""
    up: dict = {}

    def top(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    others = [x for x in up if top(x) != x]
    return [top(x) for x in others], others


def _stars(links: DataFrame) -> DataFrame:
    """``links`` (u, v) contracted within each task, some at a time."""
    kind = links.schema["u"].dataType.simpleString()

    def kernel(batches):
        u, v = [], []
        for b in batches:
            for lo in range(0, b.num_rows, CONTRACTED):
                cut = b.slice(lo, CONTRACTED)
                u, v = contracted(u + cut.column(0).to_pylist(), v + cut.column(1).to_pylist())
                if len(u) >= CONTRACTED:
                    yield pa.RecordBatch.from_arrays([pa.array(u, b.column(0).type), pa.array(v, b.column(0).type)], names=["u", "v"])
                    u, v = [], []
                typed = b.column(0).type
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, typed), pa.array(v, typed)], names=["u", "v"])

    return links.select("u", "v").mapInArrow(kernel, f"u {kind}, v {kind}")


def _tangled(edges: DataFrame) -> tuple[int, int]:
    """The number of links, and of nodes that hang on two others or hang on one while others hang on them."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(1).alias("hangs")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    found = nodes.agg(F.coalesce(F.sum("hangs"), F.lit(0)).alias("n"), F.count_if((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("least") == 0))).alias("tangled")).first()
    return found.n, found.tangled


def components(pairs: DataFrame, most: int) -> DataFrame:
    """(node, root): every node of ``pairs`` (a, b), of which there are ``most`` or fewer, with the least node that it reaches.

    Alternating large and small stars until all links are stars. Each step's links are contracted
    in their tasks first, as many at a time as memory allows, and there are no more tasks than
    the number of links needs, so that a graph of few links is nearly done after one contraction.
    Least nodes are written before the join, so that AQE can split the tasks of a hub. A link of
    a node to itself, or with a null, is left out; without links there are no rows.
    """
    spark = pairs.sparkSession
    links = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("a <> b")
    edges, at = stored_at(few(_stars(links).distinct(), most), "links")
    while True:
        n, tangled = _tangled(edges)
        if not tangled:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_at = stored_at(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n), "least")
        # large star: larger neighbours of u hang on the least node near u
        large, large_at = stored_at(few(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), n), "large")
        # small star: u and its smaller neighbours hang on the least of them
        small_least, small_at = stored_at(few(large.groupBy("v").agg(F.min("u").alias("m")), n), "small-least")
        small = large.join(small_least, "v")
        hung = small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).where("u <> v")
        edges, next_at = stored_at(few(_stars(few(hung, n)).distinct(), n), "small")
        for path in (at, least_at, large_at, small_at):
            discard(spark, path)
        at = next_at
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
