"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Two fingerprints that differ in at most two
bits have a half in which they differ in at most one bit: the low one, or, if that holds both
bits, the high one is equal. So the low half is indexed under its 32 variants with one bit
blanked and the high half as it is; equal entries meet in an equality join, and the full
distance is verified in the join's condition. Exact copies share a fingerprint, so only
distinct fingerprints are indexed, however large a group of copies is. Each linked pair is
found under one entry only, the lowest in which it shows.

Where more than ``DENSE`` distinct fingerprints share a half, their entries are not paired but
indexed again, under the blanked variants of the other half: one blank where one bit is blanked
already, two where the half is equal. Whatever then shares both is at most two bits apart, so
each links to the least of them alone. A family of m fingerprints so costs entries in
proportion to m, not m squared candidates, and everything reaches what it reached before.

Links become components by alternating stars: rounds of aggregations over the links, each
written to the shared folder, so no group is collected and lost executors cost a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_position, clash_free, discard, per_batch, stored, stored_at, texts

#: Fixed by the contract: words to a shingle, hash seed, linked distance.
SHINGLE_WORDS, HASH_SEED, MAX_DISTANCE = 3, 42, 2
HALF = 32
MASK = (1 << HALF) - 1
#: Distinct fingerprints that may share a half before they are indexed by both halves.
DENSE = 64
#: Entries of the index for each fingerprint: the variants of the low half, and the high half.
ENTRIES = HALF + 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned number; no words give 0."""
    words = (text or b"").lower().split()  # bytes.lower touches A-Z only; split is on ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    lo, hi = begins[:n].tolist(), ends[-n:].tolist()
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(lo, hi, strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    values = np.fromiter((fingerprint(t) for t in texts(b.column(2))), dtype=np.uint64, count=b.num_rows)
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values.view(np.int64))], names=["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): one row per row of ``docs``; null and empty texts have fp 0, ``mark`` is a hash of the text."""
    rows = clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text")
    return per_batch(rows, _kernel, "doc_id bigint, mark bigint, fp bigint")


def _low(fp: str) -> Column:
    return F.col(fp).bitwiseAND(F.lit(MASK))


def _high(fp: str) -> Column:
    return F.shiftrightunsigned(fp, HALF)


def _low_bit(x: Column) -> Column:
    """Position of the lowest set bit, 0 if none is set."""
    return F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1).cast("int"))


def _index(distinct: DataFrame) -> DataFrame:
    """(fp, slot, v): the index entries of every fingerprint. ``HALF`` is the slot of the whole high half."""
    slots = F.expr(
        f"""concat(transform(sequence(0, {HALF - 1}), i -> named_struct('slot', i, 'v', (fp & {MASK}L) & ~shiftleft(1L, i))),
                   array(named_struct('slot', {HALF}, 'v', shiftrightunsigned(fp, {HALF}))))"""
    )
    return distinct.select("fp", F.explode(slots).alias("s")).select("fp", "s.slot", "s.v")


def _found(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of two indexes under equal entries, each under the lowest of its entries."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low = differ.bitwiseAND(F.lit(MASK))
    first = F.when(F.bit_count(low) <= 1, _low_bit(low)).otherwise(F.lit(HALF))
    # entries are many times the fingerprints by whose size Spark would broadcast them
    met = a.withColumnRenamed("fp", "a").join(b.withColumnRenamed("fp", "b").hint("merge"), "key")
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= MAX_DISTANCE) & (F.col("key").bitwiseAND(F.lit(63)) == first)).select("a", "b")


def dense_halves(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(slot, v): index entries that more than ``dense`` fingerprints may share."""
    lows = distinct.groupBy(_low("fp").alias("fp")).count().where(F.col("count") > dense).select("fp")
    blanked = F.expr(f"transform(sequence(0, {HALF - 1}), i -> named_struct('slot', i, 'v', fp & ~shiftleft(1L, i)))")
    low = lows.select(F.explode(blanked).alias("s")).select("s.slot", "s.v").distinct()
    high = distinct.groupBy(_high("fp").alias("v")).count().where(F.col("count") > dense).select(F.lit(HALF).alias("slot"), "v")
    return low.union(high)


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): members of dense entries, each linked to the least of those with which it shares variants of both halves."""
    one = F.expr(f"transform(sequence(0, {HALF - 1}), i -> named_struct('w', shiftrightunsigned(fp, {HALF}) & ~shiftleft(1L, i), 'blanks', shiftleft(1L, i)))")
    # two bits of the other half, once that half's partner is equal: at slot 0 by the low half itself
    pairs = f"flatten(transform(sequence(1, {HALF - 1}), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    two = lambda other: F.expr(f"transform({pairs}, m -> named_struct('w', {other} & ~m, 'blanks', m))")
    spread = lambda rows, entries, v: rows.select("fp", "slot", v.alias("v"), F.explode(entries).alias("e")).select("fp", "slot", "v", "e.w", "e.blanks")
    by_one = spread(members.where(F.col("slot") < HALF), one, F.col("v"))
    by_low = spread(members.where("slot = 0"), two(f"shiftrightunsigned(fp, {HALF})"), _low("fp")).withColumn("slot", F.lit(HALF + 1))
    by_high = spread(members.where(F.col("slot") == HALF), two(f"(fp & {MASK}L)"), F.col("v"))
    key = ["slot", "v", "w", "blanks"]
    entries = by_one.union(by_low).union(by_high)
    least = stored(entries.groupBy(*key).agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    # entries are hundreds of times the members by whose size Spark would broadcast them
    return entries.join(least.hint("merge"), key).where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints at most two bits apart.

    Every such pair once, but for pairs within a dense entry: those are linked by way of the
    least fingerprint they share variants with, each link being at most two bits too.
    """
    # a named number of partitions: what is small before it is spread would else be few tasks
    index = _index(distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    hot = stored(dense_halves(distinct, dense), "dense")
    # slot and value fit one long: 6 bits and 32 bits
    keyed = lambda df: df.select("fp", F.shiftleft("v", 6).bitwiseOR(F.col("slot").cast("bigint")).alias("key"))
    if hot.isEmpty():
        return _found(keyed(index), keyed(index))
    hot = bounded(hot)
    sparse = keyed(index.join(hot, ["slot", "v"], "left_anti"))
    return _found(sparse, sparse).union(_stars(stored(index.join(hot, ["slot", "v"], "left_semi"), "members"))).distinct()


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): every node of ``pairs`` with the least node that it reaches.

    Alternating large and small stars until the links no longer change. A star joins a node's
    neighbours to the least of them, so a hub's links are never paired with each other; the
    least ones are written first, so that AQE can split the tasks of a hub.
    """
    spark = pairs.sparkSession
    edges, at = stored_at(pairs.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_at = stored_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # large star: larger neighbours of u hang on the least node near u
        large, large_at = stored_at(both.where("v > u").join(bounded(least), "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "large")
        # small star: u and its smaller neighbours hang on the least of them
        small_least, small_at = stored_at(large.groupBy("v").agg(F.min("u").alias("m")), "small-least")
        small = large.join(bounded(small_least), "v")
        hung = small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        edges, next_at = stored_at(hung, "small")
        for path in (at, least_at, large_at, small_at):
            discard(spark, path)
        at = next_at
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp) of every row, and (fp, root) of every distinct fingerprint; root is a fingerprint."""
    fps = stored(fingerprints(docs), "fingerprints")
    distinct = stored(fps.select("fp").distinct(), "distinct")
    comp = components(links(distinct))
    return fps, stored(bounded(distinct).join(comp, distinct.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the least doc_id reachable over links of at most two differing bits,
    the row's own included. Null and empty texts have fingerprint zero and link like any
    other; long texts are read whole; repeated rows stay repeated; a null doc_id is kept and
    never wins the minimum unless its whole component has none. An empty table gives an empty
    one; no column but doc_id and text is looked at.
    """
    fps, rooted = _rooted(docs)
    # least ids by fingerprint first: map-side combined, so copies never meet in one task
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = stored(least.join(bounded(rooted), "fp").groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    of_fp = stored(rooted.join(bounded(ids), "root").select("fp", "component_id"), "components")
    # a fingerprint may hold a third of all rows: the large side is split, never the pairs
    return fps.join(bounded(of_fp), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of least doc_id.

    Among rows of one doc_id, or without any, the lesser hash of the text decides; a row
    without an id is kept only where its component has no id at all. Rows equal in id and text
    are reduced to one. All columns stay as they were, whatever their names.
    """
    fps, rooted = _rooted(docs)
    # copies are counted by id and text, then combined on the map side: they never meet in one task
    rows = fps.groupBy("fp", "doc_id", "mark").agg((F.count("*") > 1).alias("repeated"))
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark", "repeated")).alias("first"))
    chosen = least.join(bounded(rooted), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = stored(chosen.select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"), "first.repeated"), "kept")
    flat, names = by_position(docs), docs.columns
    doc, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    rows = flat.withColumn("mark", F.xxhash64(text))
    of = doc.cast("bigint").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    # the kept ids grow with the documents: one plan at every size, never a broadcast
    once = rows.join(kept.where("not repeated").hint("merge"), of, "left_semi")
    again = kept.where("repeated")
    if not again.isEmpty():
        once = once.union(rows.join(again.hint("merge"), of, "left_semi").dropDuplicates([f"c{names.index('doc_id')}", "mark"]))
    return once.drop("mark").toDF(*names)
