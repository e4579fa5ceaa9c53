"""Readers for feeds and files (S4-S14): text and JSON are parsed by Spark, frames by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Title and line lengths of orbital elements.
TITLE_MOST, LINE_LENGTH = 24, 69


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """S3: a table of a database, where a driver for it is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, time, length and content; empty files are left out before they are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0")


def fits_header(content: bytes) -> dict[str, str] | None:
    """The cards of a FITS header, None if the content is none."""
    if content[:6] != b"SIMPLE":
        return None
    cards = {}
    for i in range(0, len(content) - 79, 80):
        card = content[i : i + 80].decode("ascii", "replace")
        if card[:8].strip() == "END":
            return cards
        if card[8:10] == "= ":
            cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
    return None


def fits_records(files: DataFrame) -> DataFrame:
    """Path, exposure, gain, binning, height, width, median; unreadable files have nulls and an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    head = fits_header(bytes(content))
                    h, w, bits = int(head["NAXIS2"]), int(head["NAXIS1"]), int(head["BITPIX"])
                    cards = bytes(content).index(b"END" + b" " * 77)
                    start = (cards + 80 + 2879) // 2880 * 2880
                    a = np.frombuffer(bytes(content), dtype=f">{'f' if bits < 0 else 'i' if bits > 8 else 'u'}{abs(bits) // 8}", count=h * w, offset=start)
                    rows.append((path, float(head["EXPTIME"]), float(head.get("GAIN", "nan")), int(head.get("XBINNING", "1")), h, w, float(np.median(a) + float(head.get("BZERO", 0))), None))
                except (TypeError, KeyError, ValueError) as e:
                    rows.append((path, None, None, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "exposure", "gain", "binning", "height", "width", "median", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, exposure double, gain double, binning int, height int, width int, median double, error string")


def json_feed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Documents of a JSON feed; broken ones are left out."""
    return lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("doc")).where("doc is not null").select("doc.*")


def power_lines(lines: DataFrame) -> DataFrame:
    """Time and the powers of both hemispheres from a fixed text feed; comments are skipped."""
    pattern = r"^(\d{4}-\d{2}-\d{2}_\d{2}:\d{2})\s+(\d{4}-\d{2}-\d{2}_\d{2}:\d{2})\s+(\d+)\s+(\d+)\s*$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select("line", part(1).alias("observed"), part(3).cast("int").alias("north"), part(4).cast("int").alias("south"))


#: What is read of a KML document: folders of the document, their polygons' outer rings.
KML = "Document struct<Folder:array<struct<name:string,Placemark:array<struct<Polygon:struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>>>>>>"


def kml_rings(documents: DataFrame, kml: str = "kml") -> DataFrame:
    """Folder and ring (array of x, y) of every polygon of a KML document.

    Attributes, name spaces and character data sections are those of any XML document; one that
    is no XML has no polygon.
    """
    read = documents.select("id", F.from_xml(F.col(kml), KML, {"ignoreNamespace": "true"}).alias("d"))
    folders = read.select("id", F.explode("d.Document.Folder").alias("f")).select("id", F.col("f.name").alias("folder"), F.explode("f.Placemark").alias("p"))
    rings = folders.select("id", "folder", F.col("p.Polygon.outerBoundaryIs.LinearRing.coordinates").alias("text")).where("text is not null")
    points = F.transform(F.filter(F.split(F.trim("text"), r"\s+"), lambda p: p != ""), lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).cast("double").alias("x"), F.get(F.split(p, ","), F.lit(1)).cast("double").alias("y")))
    return rings.select("id", "folder", points.alias("ring"))


def element_records(lines: DataFrame, group: str = "grp") -> DataFrame:
    """Group, title and both lines of orbital elements; a group with any bad record gives none.

    ``lines``: group, line (from 0), value.
    """
    n = F.floor(F.col("line") / 3)
    at = lambda k: F.max(F.when(F.col("line") % 3 == k, F.rtrim("value")))
    records = lines.groupBy(group, n.alias("record")).agg(at(0).alias("title"), at(1).alias("line1"), at(2).alias("line2"))
    good = (F.length("title") <= TITLE_MOST) & (F.length("line1") == LINE_LENGTH) & (F.length("line2") == LINE_LENGTH) & F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ")
    whole = F.min(F.coalesce(good, F.lit(False)).cast("int")).over(Window.partitionBy(group))
    return records.withColumn("whole", whole).where("whole = 1").drop("whole")


def aircraft(feed: DataFrame, as_of: Column, most_age: int = 60) -> DataFrame:
    """One row an aircraft of documents that are not stale; altitude by the best field there is."""
    schema = "now double, aircraft array<struct<flight:string,hex:string,lat:double,lon:double,alt_geom:double,alt_baro:double,altitude:double>>"
    docs = json_feed(feed, schema).where(F.abs(as_of - F.col("now")) <= most_age)
    rows = docs.select("now", F.explode("aircraft").alias("a"))
    height = F.coalesce("a.alt_geom", "a.alt_baro", "a.altitude")
    return rows.where("a.lat is not null and a.lon is not null").where(height.isNotNull()).select("now", F.coalesce(F.nullif(F.trim("a.flight"), F.lit("")), "a.hex").alias("flight"), "a.lat", "a.lon", height.alias("height"))


def sensor_slots(readings: DataFrame) -> DataFrame:
    """(ts, slot, value) of arrays of readings; failed readings are null and left out."""
    return readings.select("ts", F.posexplode("values").alias("slot", "value")).where("value is not null")


def catalogue(rows: DataFrame, faintest: float) -> DataFrame:
    """Ra, dec, vmag of the rows with all four fields, brightest first."""
    whole = rows.where((F.size("star") >= 4) & (F.get("star", F.lit(1)) <= faintest))
    return whole.select(F.get("star", F.lit(2)).alias("ra"), F.get("star", F.lit(3)).alias("dec"), F.get("star", F.lit(1)).alias("vmag")).orderBy("vmag", "ra")
