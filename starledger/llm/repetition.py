"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words get 64-bit numbers; rolling hashes of several n-gram lengths run over them in numpy,
one multiply and add a length. Windows of equal hash are verified on the words themselves.
A length's coverage is the share of a text's word characters that lie in later occurrences of
its duplicated n-grams, overlaps counted once; the lines' coverage is that of later copies of
lines. A text is kept if every coverage is at most its limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash_free, filtered, per_batch, texts

#: Fixed by the contract: window, least words, largest share of repeated words in percent.
BASE_WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Largest coverage by n-gram length, and of duplicated lines (published web-text rules).
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64 well spread bits for small numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def duplicated(hashes: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): positions of n-grams found twice or more, by order in the text."""
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return same, same
    a, b = order[same], order[same + 1]
    if any((ids[a + k] != ids[b + k]).any() for k in range(n)):  # two n-grams of one hash
        seen: dict[tuple, int] = {}
        first, later = set(), []
        for i in range(len(hashes)):
            if (j := seen.setdefault(tuple(ids[i : i + n]), i)) != i:
                first.add(j)
                later.append(i)
        return np.array(sorted(first)), np.array(later)
    starts = np.concatenate(([True], same[1:] != same[:-1] + 1))
    return a[starts], b


def _covered(positions: np.ndarray, n: int, size: int) -> np.ndarray:
    edges = np.zeros(size + n + 1, dtype=np.int64)
    edges[positions] += 1
    edges[positions + n] -= 1
    return np.cumsum(edges)[:size] > 0


def measure(text: bytes | None) -> dict:
    """All counts and coverages of one text."""
    data = text or b""
    words = data.split()
    n = len(words)
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    points = ((raw & 0xC0) != 0x80) & ~space
    out = {"n_words": n, "word_chars": int(points.sum()), "n_symbols": int(SYMBOL[raw].sum()), "n_dup_lines": 0, "n_repeat_words": 0, "line_chars": 0, "ngram_chars": [0] * len(LIMITS)}
    if not n:
        return out
    seen, later_chars = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            out["n_dup_lines"] += 1
            kept = np.frombuffer(line, dtype=np.uint8)
            later_chars += int((((kept & 0xC0) != 0x80) & ~SPACE[kept]).sum())
        elif line.strip():
            seen.add(line)
    out["line_chars"] = later_chars
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    if len(numbers) == n:
        return out
    v, h, lengths = _mixed(ids), None, None
    least = min(*LIMITS, BASE_WINDOW)
    for size in range(1, max(*LIMITS, BASE_WINDOW) + 1):
        if size > n:
            break
        h = v.copy() if h is None else h[:-1] * MULTIPLIER + v[size - 1 :]
        if size < least or (size not in LIMITS and size != BASE_WINDOW):
            continue
        first, later = duplicated(h, ids, size)
        if not len(later):
            break  # no longer n-gram repeats either
        if lengths is None:
            begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
            lengths = np.add.reduceat(points.astype(np.int64), begins)
        if size in LIMITS:
            out["ngram_chars"][list(LIMITS).index(size)] = int(lengths[_covered(later, size, n)].sum())
        if size == BASE_WINDOW:
            out["n_repeat_words"] = int(_covered(np.concatenate((first, later)), size, n).sum())
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    failed = m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]
    return failed, not failed and m["line_chars"] <= LINE_LIMIT * m["word_chars"] and all(c <= most * m["word_chars"] for c, most in zip(m["ngram_chars"], LIMITS.values(), strict=True))


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, line_chars bigint, ngram_chars array<bigint>"


def _kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    rows = [measure(t) for t in texts(b.column(1))]
    said = [verdict(m) for m in rows]
    counts = [pa.array([m[k] for m in rows], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return pa.RecordBatch.from_arrays(
        [b.column(0), *counts, pa.array([x for x, _ in said]), pa.array([x for _, x in said]), pa.array([m["line_chars"] for m in rows], pa.int64()), pa.array([m["ngram_chars"] for m in rows], pa.list_(pa.int64()))],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def coverage(docs: DataFrame) -> DataFrame:
    """All measures, the coverages included, for every row of ``docs``.

    Null and empty texts have no words: they fail the base rule and are not kept. Texts are
    measured whole, in time and memory in proportion to their length. Repeated rows give
    repeated rows, an empty table an empty one; no column but doc_id and text is looked at.
    """
    return per_batch(clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text"), _kernel, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``coverage``, which states the edge cases."""
    return coverage(docs).drop("line_chars", "ngram_chars")


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that fail a rule; all columns as they were, whatever their names."""
    return filtered(docs, "text", lambda values: [verdict(measure(t))[1] for t in values])


def _share(n: int) -> str:
    """CTEs of the repeated n-grams of one length, and of the characters that they cover.

    A longer n-gram can only repeat where its first words do.
    """
    key = f"doc_id, hash({', '.join(f'w{k}' for k in range(n))})"
    source = "wd where w4 is not null" if n == 5 else f"wd join (select doc_id, i from g5 where n > 1) x using (doc_id, i) where w{n - 1} is not null"
    return f"""
g{n} as (select doc_id, i, row_number() over (partition by {key} order by i) as rn, count(*) over (partition by {key}) as n from {source}),
s{n} as (select c.doc_id, sum(length(w0)) as chars from (select distinct doc_id, i + k as i from g{n}, range({n}) t(k) where rn > 1) c join wd using (doc_id, i) group by c.doc_id)"""


ORACLE = (
    r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
ln as (select doc_id, line, row_number() over (partition by doc_id, line order by i) as rn from
       (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from w) where regexp_matches(line, '[^\x20\x09-\x0D]')),
wd as (select doc_id, i, w0, """
    + ", ".join(f"lead(w0, {k}) over (partition by doc_id order by i) as w{k}" for k in range(1, 10))
    + r""" from (select doc_id, unnest(ws) as w0, generate_subscripts(ws, 1) as i from w) x),
dl as (select doc_id, count(*) as n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) as chars from ln where rn > 1 group by doc_id),"""
    + ",".join(map(_share, LIMITS))
    + r""",
r8 as (select doc_id, count(distinct i + k) as n from g8, range(8) t(k) where n > 1 group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dl.n, 0)::bigint as n_dup_lines, coalesce(r8.n, 0)::bigint as n_repeat_words,
      """
    + " and ".join([f"coalesce(dl.chars, 0) <= {LINE_LIMIT} * length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))", *[f"coalesce(s{n}.chars, 0) <= {x} * length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))" for n, x in LIMITS.items()]])
    + """ as good
      from w left join dl using (doc_id) left join r8 using (doc_id) """
    + " ".join(f"left join s{n} using (doc_id)" for n in LIMITS)
    + """)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and good as kept from m"""
)
