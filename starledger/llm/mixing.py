"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: target weight times the size of the mixture, over
the source's own size. A document's number of copies is the inverse of a Poisson distribution
with that mean at a uniform number hashed from seed and doc_id, so it depends neither on the
partitioning nor on other documents. Copies are exploded and shuffled globally by a hash of
seed, doc_id and copy.

A mean above ``STEP`` is cut into equal parts with a uniform number each; the sum of Poisson
counts is Poisson, so no rate is capped and the tables of the inverse stay short.

A lone document of a small source may stand for a third of the mixture. So documents of sources
whose rate takes more than ``HOT_DRAWS`` draws are drawn for and copied in blocks of ``BLOCK``,
dealt over all tasks: no task draws or writes more than a block at a time of one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position, clash_free, stored

SEED = 20
#: Largest mean of one draw.
STEP = 16.0
#: Terms of the distribution that are kept; the rest is below 1e-16 for means up to STEP.
TERMS = 80
#: Draws of a document from which on they, and its copies, are dealt in blocks; draws or copies to a block.
HOT_DRAWS, BLOCK = 64, 1000
#: Sources whose rates a broadcast may hold; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, rate): mean copies of a document of each source.

    ``weights``: target shares by source, any scale; absent sources get 0; None: all the same.
    ``total``: documents in the mixture, None: as many as there are. A null source is a
    source of its own, named by the empty key in ``weights``.
    """
    sizes = docs.groupBy(F.col("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = stored(sizes.withColumn("weight", weight), "sources")
    sums = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    if not sums.w:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(sums.w))
    return sizes.select("source", (share * F.lit(float(sums.n if total is None else total)) / F.col("n")).alias("rate"))


def _tables(rate: DataFrame) -> DataFrame:
    """(source, rate, draws, cdf): cdf[k] = P(count <= k) of one draw."""
    mean = F.col("rate") / F.col("draws")
    log_factorial = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(TERMS)])
    cdf = F.expr(
        """if(mean > 0, aggregate(sequence(0, 79), cast(array() as array<double>),
             (a, k) -> concat(a, array(coalesce(try_element_at(a, -1), 0d) + exp(k * ln(mean) - mean - lf[k])))), array(1d))"""
    )
    return rate.withColumn("draws", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("bigint")).withColumn("mean", mean).withColumn("lf", log_factorial).withColumn("cdf", cdf).select("source", "rate", "draws", "cdf")


def _counted(seed: int, doc: Column, first: Column, last: Column) -> Column:
    """Copies that the draws from ``first`` to ``last`` of a document give together."""
    draws = F.sequence(first.cast("bigint"), last.cast("bigint"))
    # the numbers first: within the filter each would be hashed once a term
    numbers = F.transform(draws, lambda j: uniform(str(seed), doc, j.cast("string")))
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, u: a + F.size(F.filter("cdf", lambda p: p <= u)))


def _in_blocks(joined: DataFrame, doc: Column, seed: int) -> DataFrame:
    """``joined`` once for each block of a document's copies, with the block's first and last, dealt over the tasks by block."""
    tasks = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda n: F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / BLOCK).cast("bigint"))
    edge = lambda b, n: (F.col(b) * BLOCK + 1, F.least((F.col(b) + 1) * BLOCK, F.col(n)))
    drawn = joined.select(doc.alias("drawn_doc"), F.col("mixed_source").alias("drawn_source"), "draws", "cdf").dropDuplicates(["drawn_doc", "drawn_source"])
    parts = drawn.select("*", F.explode(blocks("draws")).alias("block")).repartition(tasks, "drawn_doc", "block")
    counts = parts.groupBy("drawn_doc", "drawn_source").agg(F.sum(_counted(seed, F.col("drawn_doc"), *edge("block", "draws"))).alias("copies"))
    counts = stored(counts.where("copies > 0"), "copies")
    met = joined.join(counts, (doc == F.col("drawn_doc")) & F.col("mixed_source").eqNullSafe(F.col("drawn_source"))).drop("cdf", "draws", "drawn_source")
    dealt = met.withColumn("block", F.explode(blocks("copies"))).repartition(tasks, "drawn_doc", "block")
    first, last = edge("block", "copies")
    return dealt.withColumn("first", first).withColumn("last", last)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, numbered: bool = True) -> DataFrame:
    """``docs`` repeated to the target weights and shuffled, with copy and shuffle_key.

    ``copy`` counts from 1; ``shuffle_key`` is the order of the global shuffle. Without
    ``numbered`` the rows have the columns of ``docs`` and no others. Rows keep all their
    columns, whatever they are called; with ``numbered`` columns of ``docs`` named copy or
    shuffle_key are replaced. Null and empty texts are documents like any other, and no text is
    looked at, however long. Rows of one doc_id share their draw, so repeated rows are repeated
    alike; null ids draw as the empty text; an empty table gives an empty one.
    """
    rate = rates(clash_free(docs, "source"), weights, total)
    table = _tables(rate)
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    # names of its own, so that columns of the documents never clash
    flat, names = by_position(docs), docs.columns
    doc, source = (F.col(f"c{names.index(n)}") for n in ("doc_id", "source"))
    doc = F.coalesce(doc.cast("string"), F.lit(""))
    table = table.withColumnRenamed("source", "mixed_source")
    kept = [i for i, n in enumerate(names) if not (numbered and n in ("copy", "shuffle_key"))]
    joined = flat.join(table, source.eqNullSafe(F.col("mixed_source")))
    few = joined.where(F.col("draws") <= HOT_DRAWS).withColumn("copies", _counted(seed, doc, F.lit(1), F.col("draws"))).where("copies > 0")
    spread = few.select(*[f"c{i}" for i in kept], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    if not rate.where(F.col("rate") > HOT_DRAWS * STEP).isEmpty():
        many = _in_blocks(joined.where(F.col("draws") > HOT_DRAWS), doc, seed)
        spread = spread.union(many.select(*[f"c{i}" for i in kept], F.explode(F.sequence(F.col("first"), F.col("last"))).alias("copy")))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), doc, F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    mixed = spread.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return mixed.toDF(*[names[i] for i in kept], "copy", "shuffle_key") if numbered else mixed.drop("copy", "shuffle_key").toDF(*names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy, shuffle_key, text: the whole mixture, all sources to one weight."""
    return mix(clash_free(docs, "doc_id", "source", "text")).select("doc_id", "source", "copy", "shuffle_key", "text")


ORACLE = """
with sizes as (select source, count(*) n from documents group by source),
rates as (select source, 1.0::double / (select count(*) from sizes) * (select sum(n) from sizes)::double / n rate from sizes),
draws as (select *, greatest(ceil(rate / 16.0), 1)::bigint draws from rates),
cdf as (select source, k, sum(exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1))) over (partition by source order by k) p
        from draws, range(80) t(k)),
d as (select doc_id, documents.source, text, draws from documents join draws on documents.source is not distinct from draws.source),
u as (select doc_id, source, text, j, ('0x' || substr(md5('20:' || coalesce(doc_id::varchar, '') || ':' || j::varchar), 1, 13))::bigint / 4503599627370496.0::double as u
      from d, lateral (select unnest(range(1, draws + 1)) j)),
c as (select doc_id, source, text, (select count(*) from cdf where cdf.source is not distinct from u.source and p <= u.u) n from u),
s as (select doc_id, source, text, sum(n)::bigint n from c group by doc_id, source, text)
select doc_id, source, copy::bigint as copy, ('0x' || substr(md5('20-order:' || coalesce(doc_id::varchar, '') || ':' || copy::varchar), 1, 15))::bigint as shuffle_key, text
from s, lateral (select unnest(range(1, n + 1)) as copy)
"""
