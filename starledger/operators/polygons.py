"""Boxes against polygons of any form (J12): concave, with holes, touching themselves.

Polygons become rows of edges. A box meets a polygon if an edge touches the box, or if no edge
does and its centre is inside: an odd number of edges lies to the right of it. Boxes and edges
meet by equality of grid cells; centres meet the edges of a polygon by the band of their height,
and only those polygons whose bounds have the centre's cell. Crossings are counted by an
aggregation, so a coast of a million points is as many rows, not one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(polygons: DataFrame) -> DataFrame:
    """polygon, x1, y1, x2, y2 of every ring; open rings are closed.

    ``polygons``: polygon, rings (array of arrays of x, y structs; the first is the outline, the
    others are holes). Null and empty rings have no edges.
    """
    rings = polygons.select("polygon", F.explode("rings").alias("ring")).where(F.size("ring") > 0)
    following = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    each = rings.select("polygon", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e"))
    return each.select("polygon", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def edge_meets_box() -> Column:
    """Whether the edge x1, y1, x2, y2 has a point in the box left, low, right, high, borders included."""
    side = lambda x, y: (F.col(x) - F.col("x1")) * (F.col("y2") - F.col("y1")) - (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1"))
    corners = [side(x, y) for x in ("left", "right") for y in ("low", "high")]
    spans = (F.least("x1", "x2") <= F.col("right")) & (F.greatest("x1", "x2") >= F.col("left")) & (F.least("y1", "y2") <= F.col("high")) & (F.greatest("y1", "y2") >= F.col("low"))
    return spans & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def boxes_meet(boxes: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(id, polygon), each once: the polygons that each box touches, lies in or holds.

    ``boxes``: id, left, low, right, high. ``cell`` is the width of the grid, best a few boxes wide.
    """
    rows = edges(polygons)
    across = rows.withColumn("cx", _cells(F.least("x1", "x2"), F.greatest("x1", "x2"), cell)).withColumn("cy", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))
    spread = boxes.withColumn("cx", _cells(F.col("left"), F.col("right"), cell)).withColumn("cy", _cells(F.col("low"), F.col("high"), cell))
    touched = spread.join(across, ["cx", "cy"]).where(edge_meets_box()).select("id", "polygon")

    bounds = rows.groupBy("polygon").agg(F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"))
    covered = bounds.withColumn("cx", _cells(F.col("w"), F.col("e"), cell)).withColumn("cy", _cells(F.col("s"), F.col("n"), cell)).select("polygon", "cx", "cy")
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("low") + F.col("high")) / 2
    centres = boxes.select("id", x.alias("x"), y.alias("y")).withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    bands = rows.where("y1 <> y2").withColumn("cy", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))
    beside = centres.join(covered, ["cx", "cy"]).join(bands, ["polygon", "cy"])
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    right = F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    inside = beside.where(spans & right).groupBy("id", "polygon").count().where("count % 2 = 1").select("id", "polygon")
    return touched.union(inside).distinct()
