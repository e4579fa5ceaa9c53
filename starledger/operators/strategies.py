"""Strategies by name (E1-E7): what the observatory chooses in its configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions import sensors

from . import frames, rollups

#: The next exposure and gain from exposure, gain and brightness.
EXPOSURES: dict[str, Callable[[Column, Column, Column], tuple[Column, Column]]] = {
    "exposure_first": lambda e, g, adu: (sensors.next_exposure(e, adu, 75.0, 0.5, 1e-5, 60.0), g),
    "gain_first": lambda e, g, adu: (e, F.least(F.lit(1000.0), F.greatest(F.lit(0.0), F.when(adu > 0, g + 20 * F.log10(F.lit(75.0) / adu)).otherwise(g)))),
}
#: Stretches of a pixel table.
STRETCHES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "deviation": lambda px: frames.deviation_stretch(px, 2.25),
    "midtones": lambda px: px.withColumn("v", frames.midtone_levels(F.col("v"), 0.25)),
    "midtones_twice": lambda px: px.withColumn("v", F.floor(F.round(frames.midtones(frames.midtones(F.col("v") / 255, 0.35), 0.35) * 255, 6)).cast("int")),
    "adaptive": frames.adaptive_midtones,
}
#: Stacks of a pixel table.
STACKS: dict[str, Callable[[DataFrame], DataFrame]] = {how: (lambda px, how=how: frames.stack(px, how)) for how in ("average", "maximum", "minimum")} | {"sigma_clipped": lambda px: frames.clipped_stack(px, 5.0)}
#: E5: jobs over frames.
JOBS: dict[str, Callable[[DataFrame], DataFrame]] = {"night_rollup": rollups.night_rollup, "night_rollup_defaults": rollups.night_rollup_defaults}
#: The remote place of an asset by transport; the transports themselves are outside of Spark.
UPLOADS: dict[str, Callable[[], Column]] = {
    "object_store": lambda: F.concat_ws("/", F.lit("s3://store"), "kind", F.col("id").cast("string")),
    "file_transfer": lambda: F.concat(F.lit("sftp://host/"), F.col("camera_id").cast("string"), F.lit("/"), F.date_format("day_date", "yyyyMMdd"), F.lit("/"), F.col("kind"), F.lit("-"), F.col("id").cast("string")),
    "web_folder": lambda: F.concat(F.lit("https://dav/"), F.date_format("day_date", "yyyy-MM"), F.lit("/"), F.col("id").cast("string")),
}


def named(kind: dict[str, Callable], name: str) -> Callable:
    """The strategy of that name; an unknown name says which there are."""
    if name not in kind:
        raise ValueError(f"{name}: one of {', '.join(sorted(kind))} is known")
    return kind[name]


def hooked(df: DataFrame, key: str, document: Column, hook: Callable[[dict], dict | None]) -> DataFrame:
    """Each row's JSON document through a hook; its keys replace or extend the document's.

    A hook that fails or gives nothing leaves the document as it was, with the failure beside it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["key"], b["document"], strict=True):
                doc = json.loads(text)
                try:
                    out.append((k, json.dumps(doc | (hook(doc) or {}), sort_keys=True), None))
                except Exception as e:
                    out.append((k, json.dumps(doc, sort_keys=True), type(e).__name__))
            yield pd.DataFrame(out, columns=["key", "document", "failure"])

    return df.select(F.col(key).cast("bigint").alias("key"), document.alias("document")).mapInPandas(run, "key bigint, document string, failure string")
