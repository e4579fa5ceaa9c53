"""Boxes against concave, holed and self-touching polygons, by a plain test of every edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.operators import polygons

U = [[(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)]]
HOLE = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]
BOW = [[(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)]]
SCHEMA = "polygon int, rings array<array<struct<x:double,y:double>>>"


def met(spark, shapes, boxes, cell=1.5):
    p = spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)], SCHEMA)
    b = spark.createDataFrame([(i, *map(float, box)) for i, box in enumerate(boxes)], "id int, left double, low double, right double, high double")
    rows = [tuple(r) for r in polygons.boxes_meet(b, p, cell).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_gaps_holes_and_waists(spark):
    boxes = [(1.4, 2, 2.6, 3), (0.2, 2, 0.8, 3), (1.4, 1.4, 2.6, 2.6), (1.2, 2.1, 2.8, 2.9), (1.9, 3.2, 2.1, 3.4), (-5, -5, 9, 9), (4, 4, 5, 5), (4.01, 4.01, 5, 5), (0.4, 1.9, 0.6, 2.1)]
    assert met(spark, [U], boxes) == {(1, 0), (5, 0), (6, 0), (8, 0)}  # the gap of a U is outside, a common corner is not
    assert met(spark, [HOLE], boxes) == {(0, 0), (1, 0), (4, 0), (5, 0), (6, 0), (8, 0)}  # the first box touches the hole's border
    assert met(spark, [BOW], boxes) == {(0, 0), (1, 0), (2, 0), (3, 0), (5, 0), (6, 0), (8, 0)}


def plain(rings, box):
    left, low, right, high = box
    x, y, odd = (left + right) / 2, (low + high) / 2, False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = np.linspace(0, 1, 4001)
            if ((ax + (bx - ax) * t >= left) & (ax + (bx - ax) * t <= right) & (ay + (by - ay) * t >= low) & (ay + (by - ay) * t <= high)).any():
                return True
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.7, 5.0])
def test_random_polygons(spark, cell):
    """Spiky rings and boxes of all sizes, whatever the width of the cells."""
    rng = np.random.default_rng(8)
    shapes = [U, HOLE, BOW]
    for _ in range(6):
        angle, reach = np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(0.5, 4, 9)
        shapes.append([[(float(2 + r * np.cos(a)), float(2 + r * np.sin(a))) for a, r in zip(angle, reach, strict=True)]])
    boxes = [(x, y, x + w, y + h) for x, y, w, h in zip(rng.uniform(-3, 6, 60), rng.uniform(-3, 6, 60), rng.uniform(0.05, 2, 60), rng.uniform(0.05, 2, 60), strict=True)]
    assert met(spark, shapes, boxes, cell) == {(i, j) for i, box in enumerate(boxes) for j, rings in enumerate(shapes) if plain(rings, box)}


def test_empty_and_null_rings(spark):
    p = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[(1.0, 1.0)]])], SCHEMA)
    b = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 5.0, 5.0, 6.0, 6.0)], "id int, left double, low double, right double, high double")
    assert {tuple(r) for r in polygons.boxes_meet(b, p, 1.0).collect()} == {(1, 4)}  # a single point is touched
    assert polygons.boxes_meet(b, p.where(F.lit(False)), 1.0).count() == 0
