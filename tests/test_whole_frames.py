"""Whole frames against numpy; no frame's own pixels are shuffled."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.operators import whole
from starledger.plans import QUERIES


def test_stretches_are_numpy(spark):
    rng = np.random.default_rng(5)
    frames = [rng.integers(10, 200, 48) for _ in range(5)] + [np.full(48, 7), np.zeros(48, dtype=int)]
    df = spark.createDataFrame([(i, [int(v) for v in f]) for i, f in enumerate(frames)], "frame int, values array<int>")
    v = F.col("values")
    got = {r.frame: r for r in df.select("frame", whole.mean(v).alias("mean"), whole.median(v).alias("median"), whole.deviation_stretch(v, 1.0).alias("d"), whole.adaptive_stretch(v, 8).alias("a")).collect()}
    for i, f in enumerate(frames):
        assert got[i]["mean"] == pytest.approx(f.mean()) and got[i]["median"] == pytest.approx(np.median(f))
        low = max(0.0, f.mean() - f.std())
        assert got[i]["d"] == np.floor(np.round(np.clip((f - low) * 255 / (255 - low), 0, 255), 6)).astype(int).tolist()
    x = frames[0].reshape(6, 8) / 255
    s = x[::2, ::2]
    shadow = np.clip(np.median(s) - 2.8 * np.median(np.abs(s - np.median(s))) * 1.4826, 0, 1)
    mtf = lambda p, m: (m - 1) * p / ((2 * m - 1) * p - m)
    want = np.floor(mtf(np.clip((x - shadow) / (1 - shadow), 0, None), mtf(np.median(s) - shadow, 0.25)) * 255)
    assert np.abs(np.array(got[0]["a"]).reshape(6, 8) - want).max() <= 1


def test_frames_of_another_shape_are_not_calibrated(spark):
    frames = spark.createDataFrame([(1, 0, [100] * 9), (2, 0, [100] * 12), (3, 5, [100] * 9)], "frame int, stack int, values array<int>")
    px = spark.createDataFrame([(0, y, x, 30 if (y, x) != (1, 1) else 120) for y in range(3) for x in range(3)], "stack int, y int, x int, v int")
    got = {r.frame: r for r in whole.calibrated(frames, whole.master_of(px), 3).collect()}
    assert got[1]["values"] == [70] * 4 + [0] + [70] * 4 and got[1].calibrated
    assert not got[2].calibrated and not got[3].calibrated and got[2]["values"] == [100] * 12


@pytest.mark.parametrize("name, most", [("stretch_deviation", 0), ("stretch_adaptive", 0), ("white_balance", 0)])
def test_no_exchange_of_a_frames_pixels(spark, sf_dir, name, most):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == most


def test_only_masters_are_joined(spark, sf_dir):
    """The dark's pixels are aggregated by stack; the frames themselves meet one row a stack."""
    plan = QUERIES["dark_subtract"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Generate") < plan.index("Join")  # pixels are spread after the join
