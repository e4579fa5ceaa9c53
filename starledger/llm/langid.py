"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords: byte n-grams of two to four bytes
that lie within a word or touch one of its edges. A linear softmax over the average gives the
languages. Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. Once trained, embedding times softmax is one table of
logits a bucket, so a text's score is a mean of table rows.

The probabilities are calibrated by one temperature on rows the training has not seen; the
least probability at which a text is still accepted is the low quantile of the rightly told
calibration rows.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, clash_free, filtered, fold, per_batch, starts_of, stored, texts, word_table

#: Parameters of the sample: labelled rows to a language, rows of all languages (beyond which
#: each has an equal share), longest text in bytes. More languages than ``LANGUAGES`` are an error.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_BYTES, LANGUAGES = 1200, 48_000, 40_000, 1000
BITS, DIM, ORDERS = 16, 16, (2, 3, 4)
BUCKETS = 1 << BITS
EPOCHS, RATE, SEED = 6, 0.4, 7
#: Share of rightly told calibration rows that rejection may cost.
REJECTED_SHARE = 0.002
#: Fold of held-out rows, fixed by the contract.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Bytes of text whose subwords are held at once.
PIECE_BYTES = 1 << 18
#: Digits, punctuation and controls part words; letters of all scripts are bytes above 0x7F or a-z.
CUT = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
TABLE = word_table(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def subwords(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: buckets of the texts' subwords one after another, and how many each text has."""
    parts = [b" " + b" ".join(v.translate(TABLE).split()) + b" " for v in values]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = starts_of([len(p) for p in parts])
    last = np.repeat(ends[1:].astype(np.int32), np.diff(ends))  # where each byte's text ends
    at = np.arange(len(data), dtype=np.int32)
    blank = data == 32
    wide = data.astype(np.uint32)
    h = wide.copy()
    inner = np.zeros(len(data), dtype=bool)  # a blank strictly inside the n-gram
    for n in range(2, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        inner = inner[:m] | blank[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        h = h[:m] * np.uint32(0x01000193) ^ wide[n - 1 : n - 1 + m]
        if n in ORDERS:
            ok = ~inner & (at[:m] + n <= last[:m])
            if n == 2:  # a text without words is two blanks
                ok &= ~(blank[:m] & blank[1 : 1 + m])
            mixed = (h[ok] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            counts = np.diff(np.concatenate(([0], np.cumsum(ok)))[np.minimum(ends, m)])
            yield (mixed >> np.uint32(32 - BITS)).astype(np.int32), counts


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text cut between words into pieces of about ``most`` bytes; no subword is lost."""
    lo = 0
    while len(text) - lo > most:
        m = CUT.search(text, lo + most)
        if m is None:
            break
        yield text[lo : m.start()]
        lo = m.end()
    yield text[lo:]


@dataclasses.dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def raw(self, values: list[bytes]) -> np.ndarray:
        sums, sizes = np.zeros((len(values), len(self.languages))), np.zeros(len(values))
        cut = [(i, p) for i, v in enumerate(values) for p in pieces(v)]
        for lo, hi in chunks([p for _, p in cut], PIECE_BYTES):
            owners = np.array([i for i, _ in cut[lo:hi]])
            for buckets, counts in subwords([p for _, p in cut[lo:hi]]):
                full = np.flatnonzero(counts)
                if len(full):
                    starts = starts_of(counts)[full]
                    np.add.at(sizes, owners[full], counts[full])
                    for k in range(len(self.languages)):
                        np.add.at(sums[:, k], owners[full], np.add.reduceat(self.logits[k][buckets], starts, dtype=np.float64))
        return sums / np.maximum(sizes, 1)[:, None] + self.bias

    def probabilities(self, values: list[bytes]) -> np.ndarray:
        return softmax(self.raw(values) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(values: list[bytes], langs: list[str], calibrate: list[bool]) -> Model:
    """A model of the texts' languages; rows marked ``calibrate`` only set the calibration."""
    names = sorted(set(langs))
    if not names:
        return Model([UNKNOWN], np.zeros((1, BUCKETS), dtype=np.float32), np.zeros(1))
    rng, of = np.random.default_rng(SEED), {x: i for i, x in enumerate(names)}
    y = np.array([of[x] for x in langs])
    emb, out, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(names))), np.zeros(len(names))
    out += rng.normal(0, 0.1, out.shape)
    train = [i for i in range(len(values)) if not calibrate[i]] or list(range(len(values)))
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i in train:
        # the whole text, and one line of it, so that short texts are met in training too
        lines = [x for x in values[i].split(b"\n") if x.strip()]
        for v in [values[i], *([lines[i % len(lines)]] if len(lines) > 1 else [])]:
            b, c = np.unique(np.concatenate([x for x, _ in subwords([v])]), return_counts=True)
            if len(b):
                rows.append((b, c / c.sum(), y[i]))
    steps, total = 0, max(1, EPOCHS * len(rows))
    for _ in range(EPOCHS):
        for j in rng.permutation(len(rows)):
            b, w, k = rows[j]
            rate = RATE * (1 - steps / total)
            h = w @ emb[b]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            emb[b] -= (rate * len(b) ** 0.5) * np.outer(w, back)
            steps += 1
    model = Model(names, np.ascontiguousarray((emb @ out).T.astype(np.float32)), bias)
    held = [i for i in range(len(values)) if calibrate[i]] or train
    raw, y = model.raw([values[i] for i in held]), y[held]
    best = min((float(-np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean()), t) for t in np.geomspace(0.02, 4, 40))
    model.temperature = float(best[1])
    p = softmax(raw / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.least = min(0.5, float(np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0
    return model


def train(docs: DataFrame, held_out: int | None = HELD_OUT, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows of ``docs`` to a language.

    Rows whose id falls in the held-out fold, rows without a language and texts that are null
    or over ``SAMPLE_BYTES`` are left out; of the others those with the least hash of id and
    text are taken, by language, and every language of the rest is learned. Without any, all
    predictions are ``und``.
    """
    labelled = clash_free(docs, "doc_id", "text", "lang").where("lang is not null and text is not null").where(F.octet_length("text") <= SAMPLE_BYTES)
    if held_out is not None:
        labelled = labelled.where(~F.coalesce(fold(F.col("doc_id"), FOLDS) == held_out, F.lit(False)))
    # a bound for each language from its hashes first, so that no language's rows are all sorted
    sizes = stored(labelled.groupBy("lang").count(), "languages")
    languages = sizes.count()
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages are more than the {LANGUAGES} that one model holds")
    rows = min(rows, SAMPLE_TOTAL // max(1, languages))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30))
    near = labelled.join(F.broadcast(sizes), "lang").withColumn("key", key).where(F.col("key") < F.lit(float(1 << 30)) * (rows * 1.2 + 20) / F.col("count"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    chosen = near.withColumn("place", place).where(F.col("place") <= rows).select("lang", "key", F.col("text").cast("binary").alias("text"))
    flat = sorted((r.lang, r.key, bytes(r.text)) for r in chosen.toLocalIterator())
    return fit([t for _, _, t in flat], [lang for lang, _, _ in flat], [k % 5 == 0 for _, k, _ in flat])


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L occurs; digits, numerals and marks are none."""
    return any(map(str.isalpha, text))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, the empty text included.
    ``rejected``: that, or a probability below the calibrated least one. Texts are read whole,
    in pieces of bounded size. Repeated rows give repeated rows, an empty table an empty one; no
    column but doc_id and text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, rejected = judge(texts(b.column(1)), shared.value)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return per_batch(clash_free(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text"), kernel, "doc_id bigint, lang_pred string, score double, rejected boolean")


def judge(values: list[bytes | None], model: Model) -> tuple[list[str], list[float], list[bool]]:
    p = model.probabilities([v or b"" for v in values])
    best = p.argmax(axis=1)
    none = [not v or not has_letter(v.decode()) for v in values]
    scores = [0.0 if x else float(p[i, best[i]]) for i, x in enumerate(none)]
    return [UNKNOWN if x else model.languages[best[i]] for i, x in enumerate(none)], scores, [x or scores[i] < model.least for i, x in enumerate(none)]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; the model learns from the other folds.

    A null id is held out of no fold. Edge cases as in ``train`` and ``predictions``.
    """
    found = predictions(docs, train(docs))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns as they were, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    return filtered(docs, "text", lambda values: [not x for x in judge(values, shared.value)[2]])
