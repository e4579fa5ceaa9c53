"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

Lines are hashed after trimming spaces; each three consecutive lines make a window, known by
128 bits of hash. Windows that occur more than once in the corpus are found by one
aggregation, which keeps the first occurrence (least doc_id, then position). All later
occurrences are removed: per document their positions are merged into covered stretches and
the text is put together from the stretches between them.

The aggregation combines on the map side, so a window that a third of all documents share
is a few partial rows. The repeated windows are written and read back before the windows are
joined to them: both sides of that join are then plain shuffles, so AQE splits the tasks of a
window that stands in a large share of all documents. Its later occurrences are combined by
document, again on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, clash_free, stored

LINES = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, w1, w2): windows of every text with at least three lines.

    ``mark`` is a hash of the text, so that rows of one doc_id with other texts stay apart.
    Windows of blank lines only are left out.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    hashed = docs.where(F.col("text").contains("\n")).select("doc_id", F.xxhash64("text").alias("mark"), lines.alias("lines"))
    hashed = hashed.where(F.size("lines") >= LINES).select("doc_id", "mark", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (F.length(x) > 0).alias("full"))).alias("h"))
    at = lambda i, k: F.get("h", i + k)
    window = lambda i: F.struct(
        i.alias("pos"),
        F.xxhash64(*[at(i, k)["a"] for k in range(LINES)]).alias("w1"),
        F.xxhash64(*[at(i, k)["b"] for k in range(LINES)]).alias("w2"),
        (at(i, 0)["full"] | at(i, 1)["full"] | at(i, 2)["full"]).alias("full"),
    )
    spread = hashed.select("doc_id", "mark", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - LINES), window)).alias("w"))
    return spread.where("w.full").select("doc_id", "mark", "w.pos", "w.w1", "w.w2")


def repeated(found: DataFrame) -> DataFrame:
    """(w1, w2, first): windows found more than once, with their first occurrence."""
    firsts = found.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "pos")).alias("first")).where("n > 1").drop("n")
    return stored(firsts, "repeated-windows")


def later_occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, mark, pos): windows that are not the first occurrence of their kind."""
    joined = found.join(repeated(found), ["w1", "w2"])
    return joined.where(~F.struct("doc_id", "mark", "pos").eqNullSafe(F.col("first"))).select("doc_id", "mark", "pos")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut out of ``text``; n_lines, n_removed.

    Other columns are untouched, whatever their names, and no row is dropped: a text whose
    lines all go is empty. A null text stays null with no lines; a text of fewer than three
    lines has no window and is kept whole, the empty text included; long texts are cut whole,
    a window at a time. Rows that repeat doc_id and text are one occurrence and all keep the
    same text; among equal doc_ids the lesser hash of the text is first; a null doc_id counts
    as the least. An empty table gives an empty one. Columns of ``docs`` named n_lines or
    n_removed are replaced.
    """
    later = later_occurrences(windows(clash_free(docs, "doc_id", "text")))
    # positions of a document's later windows, each once; a stretch before each that none covers stays
    at = later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("at", i - 1) + LINES)
    stretches = F.transform("at", lambda pos, i: F.struct(since(i).alias("from"), (pos - since(i)).alias("n")))
    cuts = at.select(F.col("doc_id").alias("cut_doc"), F.col("mark").alias("cut_mark"), F.filter(stretches, lambda x: x["n"] > 0).alias("kept"), (F.element_at("at", -1) + LINES).alias("tail"))
    flat, names = by_position(docs), docs.columns
    doc, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    joined = flat.withColumn("cut_by", F.xxhash64(text)).join(cuts, doc.eqNullSafe(F.col("cut_doc")) & (F.col("cut_by") == F.col("cut_mark")), "left")
    lines = F.split(text, "\n")
    rest = F.concat(F.flatten(F.transform("kept", lambda s: F.slice(lines, s["from"] + 1, s["n"]))), F.slice(lines, F.col("tail") + 1, F.greatest(F.size(lines) - F.col("tail"), F.lit(0))))
    joined = joined.withColumn("left_lines", F.when(F.col("tail").isNotNull(), rest))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    n_removed = F.coalesce(n_lines - F.size("left_lines"), F.lit(0)).cast("bigint")
    new_text = F.when(F.col("tail").isNull(), text).otherwise(F.array_join("left_lines", "\n"))
    kept = [i for i, n in enumerate(names) if n not in ("n_lines", "n_removed")]
    columns = [new_text.alias(f"c{i}") if i == names.index("text") else F.col(f"c{i}") for i in kept]
    return joined.select(*columns, n_lines.alias("n_lines"), n_removed.alias("n_removed")).toDF(*[names[i] for i in kept], "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every row of ``docs``."""
    return dedup(clash_free(docs, "doc_id", "text"))


ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (select doc_id, text, pos, trim(lines[pos + 1]) || chr(10) || trim(lines[pos + 2]) || chr(10) || trim(lines[pos + 3]) as win
      from l, lateral (select unnest(range(0, len(lines) - 2)) as pos)),
r as (select doc_id, text, pos, row_number() over (partition by win order by doc_id, pos) as rn from w where win <> chr(10) || chr(10)),
gone as (select distinct doc_id, text, pos + k as pos from r, range(3) t(k) where rn > 1),
x as (select doc_id, text, pos, lines[pos + 1] as line from l, lateral (select unnest(range(0, len(lines))) as pos)),
kept as (select x.doc_id, x.text, string_agg(line, chr(10) order by x.pos) as new_text, count(*) as n from x
         anti join gone on x.doc_id = gone.doc_id and x.pos = gone.pos group by x.doc_id, x.text)
select l.doc_id, case when l.text is null then null else coalesce(new_text, '') end as text,
       coalesce(len(l.lines), 0)::bigint as n_lines, (coalesce(len(l.lines), 0) - coalesce(n, 0))::bigint as n_removed
from l left join kept on l.doc_id = kept.doc_id
"""
