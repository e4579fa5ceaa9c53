"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised (A-Z lower-cased, words joined by one space) and cut into
windows of ten words; an item of fewer words is one window. All windows go into an
automaton, each document is normalised the same way and scanned once, and the matches are
mapped to word numbers and from these to offsets in the original text.

The windows of a benchmark are read in blocks of bounded size. Every benchmark of usual size
is one block; a larger one costs one scan of the documents for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, clash_free, filtered, per_batch, scratch, stored, texts, word_table

#: Fixed by the contract: words to a window and what a word is.
WINDOW_WORDS = 10
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TABLE = word_table(SEPARATORS)
#: The same words in a text that is not lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of windows that one automaton holds; about 100 bytes of memory for each. An item
#: that has a window counts as ``ITEM_CHARS`` of them, so windows of many items fill a block too.
BLOCK_CHARS, ITEM_CHARS = 2_000_000, 8


def words_of(text: bytes | None) -> list[bytes]:
    """The normalised words; UTF-8 bytes above 0x7F are word characters, A-Z has become a-z."""
    return (text or b"").translate(TABLE).split()


def windows_of(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, window): the distinct windows of every item; items without a word have none."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for item, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            w = words_of(text)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                ids.append(item)
                out.append(b" ".join(w[i : i + size]).decode())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["item_id", "window"])

    return per_batch(clash_free(items, "item_id", "text").select(F.col("item_id").cast("bigint"), "text"), kernel, "item_id bigint, window string").distinct()


class Scanner:
    """The automaton of one block; built once in each Python worker that unpickles it."""

    def __init__(self, windows: list[tuple[str, list[int | None]]]):
        self.windows, self.automaton = windows, None

    def __getstate__(self) -> dict:
        return {"windows": self.windows, "automaton": None}

    def build(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for i, (w, _) in enumerate(self.windows):
                # one character for each byte: offsets are byte offsets, words stay whole
                a.add_word(f" {w.encode().decode('latin-1')} ", (i, w.count(" ") + 1))
            a.make_automaton()
            self.automaton = a
        return self.automaton

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged ranges of hit words [from, to), and the numbers of the windows that occur."""
        a = self.build()
        if not words or not len(a):
            return [], set()
        joined = f" {b' '.join(words).decode('latin-1')} "
        found = list(a.iter(joined))
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        last = np.searchsorted(blanks, [end for end, _ in found])  # the blank after the match's last word
        ranges: list[tuple[int, int]] = []
        for lo, hi in sorted((int(e) - n, int(e)) for e, (_, (_, n)) in zip(last, found, strict=True)):
            if ranges and lo <= ranges[-1][1]:
                ranges[-1] = ranges[-1][0], max(hi, ranges[-1][1])
            else:
                ranges.append((lo, hi))
        return ranges, {i for _, (i, _) in found}


#: The automata this Python worker has built, by the broadcast list that they hold.
_BUILT: dict[int, Scanner] = {}

RANGES = "array<struct<from:bigint,to:bigint,start:bigint,end:bigint>>"


def _scanner(windows: list) -> Scanner:
    if id(windows) not in _BUILT:
        _BUILT.clear()
        _BUILT[id(windows)] = Scanner(windows)  # holds the list, so its id stays taken
    return _BUILT[id(windows)]


def _blocks(windows: DataFrame, block_chars: int) -> Iterator[list[tuple[str, list[int | None]]]]:
    """The windows with their items, a block at a time; one empty block if there are none.

    Rows come in order of window, a partition at a time, so no window's items are gathered by
    Spark; the items of one window may go on in the next block.
    """
    held: list[tuple[str, list[int | None]]] = []
    size, given = 0, False
    for r in windows.orderBy("window", "item_id").toLocalIterator():
        if held and held[-1][0] == r.window:
            held[-1][1].append(r.item_id)
        else:
            held.append((r.window, [r.item_id]))
            size += len(r.window)
        size += ITEM_CHARS
        if size >= block_chars:
            yield held
            held, size, given = [], 0, True
    if held or not given:
        yield held


def _scanned(docs: DataFrame, block: list[tuple[str, list[int | None]]]) -> DataFrame:
    """(doc_id, n_words, ranges, items) of every document for one block of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _scanner(shared.value)
        n_words, ranges, items = [], [], []
        for text in texts(b.column(1)):
            words = words_of(text)
            hit, which = scanner.scan(words)
            at = [m.span() for m in WORD.finditer(text.decode())] if hit else []
            n_words.append(len(words))
            ranges.append([{"from": lo, "to": hi, "start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in hit])
            items.append(sorted({x for i in which for x in scanner.windows[i][1]}, key=lambda x: (x is None, x)))
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("from", "to", "start", "end")]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(ranges, kind), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "n_words", "ranges", "items"])

    return per_batch(docs.select("doc_id", "text"), kernel, f"doc_id bigint, n_words bigint, ranges {RANGES}, items array<bigint>")


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, ranges (merged hit passages), items (the item_ids that occur).

    A range is from, to (word numbers, end exclusive) and start, end (code points of the
    original text, end exclusive). One row for each row of ``docs``. Null and empty texts have
    no words and no hits; texts are scanned whole, in time and memory in proportion to their
    length; repeated rows give repeated rows, an empty table an empty one; without items, or
    with items that have no word, nothing is hit; other columns are not looked at.
    """
    docs = clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    blocks = _blocks(windows_of(items, size), block_chars)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _scanned(docs, block)
    # A benchmark beyond one automaton: scan block by block, then merge by row.
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "scans")
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    while block is not None:
        _scanned(docs.select(F.col("row").alias("doc_id"), "text"), block).write.mode("append").parquet(path)
        block, following = following, next(blocks, None)
    joined = spark.read.parquet(path).groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    last = "element_at(done, -1)"
    merged = F.expr(
        f"""aggregate(ranges, cast(array() as {RANGES}), (done, x) ->
            if(size(done) > 0 and x.from <= {last}.to,
               concat(slice(done, 1, size(done) - 1), array(named_struct('from', {last}.from, 'to', greatest({last}.to, x.to),
                                                                         'start', {last}.start, 'end', greatest({last}.end, x.end)))),
               concat(done, array(x))))"""
    )
    ids = docs.select("row", F.col("doc_id").alias("id"))
    return joined.join(ids, joined.doc_id == ids.row).select(F.col("id").alias("doc_id"), "n_words", merged.alias("ranges"), "items")


def spans(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, start, end: hit passages as code points of the original text, end exclusive."""
    return hits(docs, items, block_chars=block_chars).select("doc_id", F.explode("ranges").alias("r")).select("doc_id", "r.start", "r.end")


def report(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["to"] - r["from"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    found = hits(docs, items, block_chars=block_chars).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; all columns as they were, whatever their names."""
    blocks = _blocks(windows_of(items), block_chars)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(values: list[bytes | None]) -> list[bool]:
            scanner = _scanner(shared.value)
            return [not scanner.scan(words_of(t))[0] for t in values]

        return filtered(docs, "text", keep)
    # A benchmark beyond one automaton: each block adds the numbers of the rows that it hits.
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "leaks")
    rows = stored(by_position(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("row").alias("doc_id"), F.col(f"c{docs.columns.index('text')}").alias("text"))
    while block is not None:
        _scanned(numbered, block).where(F.size("ranges") > 0).select(F.col("doc_id").alias("row")).write.mode("append").parquet(path)
        block, following = following, next(blocks, None)
    return rows.join(spark.read.schema("row bigint").parquet(path), "row", "left_anti").drop("row").toDF(*docs.columns)


ORACLE = r"""
with b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') as win
        from b, lateral (select unnest(range(0, greatest(len(w) - 9, 1))) as i) where len(w) > 0),
d as (select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select row, i, n, array_to_string(w[i + 1 : i + n], ' ') as win from d, (select distinct n from win) sizes, lateral (select unnest(range(0, len(w) - n + 1)) as i) where len(w) >= n),
m as (select row, i, g.n, item_id from g join win on g.win = win.win and g.n = win.n),
h as (select row, count(distinct i + k) as n_hit from (select distinct row, i, n from m) x, range(10) t(k) where k < n group by row),
x as (select row, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct row, item_id from m) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (row) left join x using (row)
"""
