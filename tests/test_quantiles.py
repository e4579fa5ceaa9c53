"""Exact quantiles by narrowing give what sorting gives, whatever the values are like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.operators import quantiles, rollups

P, NAMES = [0.0, 0.1, 0.5, 0.9, 1.0], ["lo", "p10", "p50", "p90", "hi"]
RNG = np.random.default_rng(9)
KINDS = {
    "even": RNG.uniform(-5, 5, 4001),
    "outlier": np.concatenate((RNG.normal(0, 1, 4000), [1e300, -1e300])),
    "ties": np.repeat([1.0, 2.0, 7.0], [1500, 1400, 1101]),
    "heavy": np.concatenate((RNG.normal(0, 1e-9, 2500), np.zeros(1500))),
    "whole": RNG.integers(0, 40, 3000).astype(float),
}


@pytest.mark.parametrize("most", [50, 10_000])
def test_same_as_sorting(spark, most):
    rows = [(k, float(v)) for k, values in KINDS.items() for v in values] + [("few", 1.0), ("few", 4.0), ("none", None)] + [(None, float(v)) for v in range(700)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    got = {r.key: r for r in quantiles.exact(df, ["key"], "v", P, NAMES, most).collect()}
    for k, values in {**KINDS, "few": [1.0, 4.0], None: list(range(700))}.items():
        assert np.allclose([got[k][n] for n in NAMES], np.quantile(values, P), rtol=1e-12, atol=1e-15), k
    assert [got["none"][n] for n in NAMES] == [None] * 5


def test_robust_statistics_of_a_hot_key(spark):
    """A camera with most of all frames gives the same row by either way."""
    rows = spark.range(6000).select(F.when(F.col("id") % 5 > 0, 1).otherwise(F.col("id") % 7 + 2).alias("camera_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("adu"))
    pick = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.select("camera_id", "median", "q", "mad", "trimmed_median").collect())
    both = [pick(rollups.robust(rows, ["camera_id"], "adu", most=m).withColumn("q", F.col("relative_mad"))) for m in (200, 10**6)]
    assert both[0] == both[1] and len(both[0]) == 8
