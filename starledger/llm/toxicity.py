"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of the embeddings of its hashed features: the word and its
first four, five, six and eight bytes, so that unseen forms of a known stem are known too. Filters
over one, two and three words run along the text, each filter's largest response is kept, and
a logistic layer over these gives the score. Embeddings start from the evidence of the training
labels for each feature; stochastic gradient descent with per-weight step sizes trains them
and all else on all labelled rows: in tasks of a few thousand from one start, whose moves are averaged.

A filter over k words is linear in each of them, so once trained a word's responses to all
filters are one table row; a text's responses are sums of rows, whatever its length.

The score is calibrated on what models of parts of the rows say of the other parts, for the
classes' shares among all labelled rows. Thresholds by language are set likewise; they make the
extra columns ``threshold`` and ``flagged`` and never enter a score.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, clash_free, cuts, fold, per_batch, starts_of, stored, texts, word_table

#: Texts that a task trains on, about; most times that it goes over fewer.
TASK_TEXTS, PASSES = 4096, 6
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 12, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 8)
#: Slope of a filter's activation below zero; none dies.
LEAK = 0.05
EPOCHS, BATCH, RATE, SEED = 3, 32, 0.05, 11
#: Least and most steps of training.
STEPS = 60, 200
#: Most words of a batch that has more than one text.
BATCH_WORDS = 1 << 16
#: What the squares of a weight's gradients start from; fractions in which moves and logits are counted.
FIRST_STEP, UNIT, GRID = 1e-2, 1 << 30, 256
#: Parts of the rows that are told by a model of the other parts, for calibration.
PARTS = 2
#: Where an embedding's evidence begins to count no more, and what one unit of it is worth.
EVIDENCE_MOST, EVIDENCE_UNIT = 24.0, 8.0
#: Least rows of a language for a threshold of its own; share of clean rows that it may flag.
LEAST_ROWS, FALSE_SHARE = 40, 0.005
#: Fixed by the contract.
FOLDS, HELD_OUT = 5, 0
TABLE = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
PAD = max(WIDTHS) - 1
#: Where the filters of each width and offset lie in a word's row of responses.
COLUMNS = {(k, o): slice(FILTERS * i, FILTERS * (i + 1)) for i, (k, o) in enumerate((k, o) for k in WIDTHS for o in range(k))}
ROW = FILTERS * sum(WIDTHS)
MOVES = [f"m{d}" for d in range(DIM)]
#: Words whose responses a Python worker remembers.
MEMORY = 150_000


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of every word's features; a prefix that the word is too short for is bucket 0."""
    from xxhash import xxh32_intdigest as digest

    rows = [[digest(w, 1) % (BUCKETS - 1) + 1, *[digest(w[:p], p) % (BUCKETS - 1) + 1 if len(w) >= p else 0 for p in PREFIXES]] for w in words]
    return np.array(rows, dtype=np.int32).reshape(len(words), 1 + len(PREFIXES))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


@dataclasses.dataclass
class Model:
    emb: np.ndarray  # buckets x dim; bucket 0 is zero
    filters: np.ndarray  # dim x ROW
    bias: np.ndarray  # filters of all widths
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = dataclasses.field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "rows")}

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Table rows of the words; row 0 is padding."""
        if "known" not in self.__dict__:
            self.known, self.rows = {b"": 0}, np.zeros((1 << 12, ROW), dtype=np.float32)
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new and len(known) + len(new) > MEMORY:
            known.clear()
            known[b""] = 0
            new = [w for w in dict.fromkeys(words) if w]
        if new:
            lo, hi = len(known), len(known) + len(new)
            if hi > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((max(hi, 2 * len(self.rows)) - len(self.rows), ROW), dtype=np.float32)))
            self.rows[lo:hi] = self.emb[features(new)].sum(axis=1) @ self.filters
            known.update(zip(new, range(lo, hi), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def logits(self, values: list[bytes | None]) -> np.ndarray:
        out = np.empty(len(values))
        values = [v or b"" for v in values]
        for lo, hi in chunks(values, 1 << 19):
            words, counts = [], []
            for v in values[lo:hi]:
                w = words_of(v)
                counts.append(len(w) + PAD)
                words += w
                words += [b""] * PAD
            ids = self._rows(words)
            responses = self.rows[ids]
            starts = starts_of(counts)[:-1]
            top = np.concatenate([np.maximum.reduceat(convolved(responses, k, ids == 0), starts, axis=0) for k in WIDTHS], axis=1)
            out[lo:hi] = leaky(top + self.bias) @ self.out + self.out_bias
        return out

    def scores(self, values: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(values) + self.shift, -30, 30)))


def leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, LEAK * x)


def convolved(responses: np.ndarray, k: int, pad: np.ndarray) -> np.ndarray:
    """Responses of the filters over ``k`` words at each word; at padding, and beyond the end, they are zero."""
    total = responses[:, COLUMNS[k, 0]].copy()
    for o in range(1, k):
        total[:-o] += responses[o:, COLUMNS[k, o]]
    total[pad] = 0  # what begins at padding would reach into the next text
    return total


def evidence(docs: list[np.ndarray], feats: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How surely each bucket's features go with label 1, from the texts' labels.

    The gain in log-likelihood of telling the labels of the texts that hold a feature by their
    own share of label 1 instead of the share of all texts, where it is the higher; less the
    logarithm of the number of buckets that were looked at, so that of many features none
    stands out by chance.
    """
    n = np.zeros((2, BUCKETS))
    for words, label in zip(docs, y, strict=True):
        n[label, np.unique(feats[words])] += 1
    return evidence_of(n, float(y.mean()))


def evidence_of(n: np.ndarray, share: float) -> np.ndarray:
    """``evidence`` from the numbers of texts with label 0 and 1 that hold each bucket's features."""
    total, share = n.sum(axis=0), max(share, 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = n[1] / total
        gain = n[1] * np.log(own / share) + np.where(n[0] > 0, n[0] * np.log((1 - own) / (1 - share)), 0.0)
    gain = np.where((total > 0) & (own > share), gain, 0.0) - np.log(max(1, int((total > 0).sum())))
    gain[0] = 0.0
    return np.clip(gain, 0.0, EVIDENCE_MOST) / EVIDENCE_UNIT


def _start(gain: np.ndarray, rng: np.random.Generator | None = None) -> Model:
    """A model before its first step."""
    rng = rng or np.random.default_rng(SEED)
    n_out = FILTERS * len(WIDTHS)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, ROW)), np.zeros(n_out), rng.normal(0, 0.1, n_out))
    model.emb[:, 0] = gain
    model.filters[0, :] = 0
    model.filters[:, 0], model.out[0] = np.eye(DIM)[0], 1.0
    model.emb[0] = 0
    return model


def _no_steps() -> dict:
    """Squares of the gradients so far, by weight."""
    n_out = FILTERS * len(WIDTHS)
    return {"emb": np.full(BUCKETS, FIRST_STEP), "filters": np.full((DIM, ROW), FIRST_STEP), "bias": np.full(n_out, FIRST_STEP), "out": np.full(n_out, FIRST_STEP), "out_bias": FIRST_STEP}


def _trained(docs: list[np.ndarray], feats: np.ndarray, y: np.ndarray) -> Model:
    """A model of the texts, not calibrated.

    The first dimension of the embeddings starts as their evidence, which the first filter of one
    word reads, so that few labels suffice for what they show plainly; all else starts at random,
    and all of it is trained.
    """
    rng = np.random.default_rng(SEED)
    model = _start(evidence(docs, feats, y), rng)
    train = np.arange(len(docs))
    few, many = sorted((train[y == c] for c in (0, 1)), key=len)
    if len(few):  # the rarer class is met as often as the other
        train = np.concatenate((many, np.resize(few, len(many))))
    state = _no_steps()
    left = min(STEPS[1], max(STEPS[0], EPOCHS * -(-len(train) // BATCH)))
    while left > 0 and len(train):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH)[:left]:
            _step(model, state, [docs[j] for j in train[i : i + BATCH]], feats, y[train[i : i + BATCH]])
            left -= 1
    return model


def fit(values: list[bytes], labels: list[int], langs: list[str | None], parts: list[int], prior: float | None = None) -> Model:
    """A model from balanced texts. ``parts``: a number for each text.

    Calibration and thresholds rest on what models of the other parts say of each part, so all
    texts train the model and none is judged by one that knows it. ``prior``: share of label 1
    among all labelled rows. Without both classes, all scores are that share.
    """
    y = np.array(labels, dtype=np.int64)
    prior = float(y.mean()) if prior is None and len(y) else prior or 0.0
    if len(set(labels)) < 2:
        n_out = FILTERS * len(WIDTHS)
        return Model(np.zeros((BUCKETS, DIM), dtype=np.float32), np.zeros((DIM, ROW)), np.zeros(n_out), np.zeros(n_out), scale=0.0, shift=30.0 if prior > 0.5 else -30.0)
    vocabulary: dict[bytes, int] = {b"": 0}
    docs = [np.array([*[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(v)], *[0] * PAD]) for v in values]
    feats = features(list(vocabulary))
    feats[0] = 0
    part = np.array(parts) % PARTS
    z = np.zeros(len(values))
    for p in set(part.tolist()):
        rest = np.flatnonzero(part != p)
        told = np.flatnonzero(part == p)
        if len(set(y[rest].tolist())) == 2:
            z[told] = _trained([docs[i] for i in rest], feats, y[rest]).logits([values[i] for i in told])
    model = _trained(docs, feats, y)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    model.scale, model.shift = _calibrated(z, y, weight)
    scores = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
    for lang in set(langs):
        clean = np.sort([s for s, x, c in zip(scores, langs, labels, strict=True) if x == lang and not c])
        if lang is not None and len(clean) >= LEAST_ROWS:
            model.thresholds[lang] = float(min(0.9, max(0.1, np.quantile(clean, 1 - FALSE_SHARE))))
    model.emb = model.emb.astype(np.float32)
    return model


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits, by weighted logistic regression."""
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic regression on the logit, weighted to the natural shares
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-6)
        m = np.array([[(h * z * z).sum() + 1e-1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [(g * z).sum() + 1e-1 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - 0.5 * da, b - 0.5 * db
    return float(max(a, 1e-2)), float(b)


def _step(model: Model, state: dict, docs: list[np.ndarray], feats: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
    """One minibatch of gradient descent; the gradient flows through each filter's best place only."""
    words = np.concatenate(docs)
    counts = np.array([len(d) for d in docs])
    starts = starts_of(counts)[:-1]
    owner = np.repeat(np.arange(len(docs)), counts)
    met = np.zeros(len(feats), dtype=bool)
    met[words] = True
    nth = np.cumsum(met) - 1  # each word of the batch is looked up once
    x = model.emb[feats[met]].sum(axis=1)
    responses = (x @ model.filters)[nth[words]]
    tops, places = [], []
    for k in WIDTHS:
        c = convolved(responses, k, words == 0)
        top = np.maximum.reduceat(c, starts, axis=0)
        at, f = np.nonzero(c == top[owner])
        place = np.zeros(top.shape, dtype=np.int64)
        place[owner[at[::-1]], f[::-1]] = at[::-1]  # the first of equals
        tops.append(top)
        places.append(place)
    pre = np.concatenate(tops, axis=1) + model.bias
    act = leaky(pre)
    p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
    d = weight * (p - y) / len(y)
    d_act = np.outer(d, model.out) * np.where(pre > 0, 1.0, LEAK)
    d_filters, hit, grads = np.zeros_like(model.filters), [], []
    for i, k in enumerate(WIDTHS):
        g = d_act[:, i * FILTERS : (i + 1) * FILTERS] * (words[places[i]] != 0)
        for o in range(k):
            at = np.minimum(places[i] + o, len(words) - 1)
            d_filters[:, COLUMNS[k, o]] += np.einsum("bfd,bf->df", x[nth[words[at]]], g)
            hit.append(words[at].ravel())
            grads.append((g[:, :, None] * model.filters[:, COLUMNS[k, o]].T[None]).reshape(-1, DIM))
    rows = feats[np.concatenate(hit)]
    flat, back = np.unique(rows.ravel(), return_inverse=True)
    d_emb = np.zeros((len(flat), DIM))
    np.add.at(d_emb, back, np.repeat(np.concatenate(grads), rows.shape[1], axis=0))
    d_emb[flat == 0] = 0
    state["emb"][flat] += (d_emb**2).mean(axis=1) * 100
    model.emb[flat] -= RATE * d_emb * 10 / np.sqrt(state["emb"][flat])[:, None]
    for name, grad in (("filters", d_filters), ("bias", d_act.sum(axis=0)), ("out", d @ act)):
        state[name] += grad**2
        getattr(model, name)[...] -= RATE * grad / np.sqrt(state[name])
    state["out_bias"] += d.sum() ** 2
    model.out_bias -= RATE * d.sum() / np.sqrt(state["out_bias"])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, lang, part): every row with a text and a label (0 or 1) outside the held-out fold, in a stored table."""
    rated = clash_free(labels, "doc_id", "toxic").where("toxic in (0, 1)").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = clash_free(docs, "doc_id", "text", "lang").where(F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    met = known.join(rated.hint("merge"), "doc_id").select("text", F.col("toxic").cast("int"), "lang", F.pmod(key, F.lit(PARTS)).cast("int").alias("part"), key.alias("key"))
    return stored(met.sortWithinPartitions("key", "text", "toxic").drop("key"), "labelled")


def _read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of each text, features of each word, labels, parts."""
    vocabulary: dict[bytes, int] = {b"": 0}
    docs = [np.array([*[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(v)], *[0] * PAD]) for v in texts(batch.column(0))]
    feats = features(list(vocabulary))
    feats[0] = 0
    return docs, feats, batch.column(1).to_numpy(), batch.column(3).to_numpy()


def _holders(labelled: DataFrame) -> np.ndarray:
    """Texts that hold each bucket's features, by part and label: summed over all rows."""

    def kernel(batches):
        n = np.zeros((PARTS, 2, BUCKETS), dtype=np.int64)
        for b in cuts(batches):
            docs, feats, y, part = _read(b)
            for words, label, p in zip(docs, y, part, strict=True):
                n[p, label, np.unique(feats[words])] += 1
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in at] + [pa.array(n[at])], names=["part", "toxic", "bucket", "n"])

    found = labelled.mapInArrow(kernel, "part int, toxic int, bucket int, n bigint").groupBy("part", "toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((PARTS, 2, BUCKETS), dtype=np.int64)
    n[tuple(found.column(c).to_numpy() for c in ("part", "toxic", "bucket"))] = found.column("n").to_numpy()
    return n


def _moved(starts: list[Model], left_out: list[int], weights: np.ndarray, passes: int):
    """A kernel: each task steps from each start over its rows but those of the part left out, and gives how far every weight came."""

    def kernel(batches):
        models = [dataclasses.replace(m, **{k: getattr(m, k).copy() for k in ("emb", "filters", "bias", "out")}) for m in starts]
        states, rng = [_no_steps() for _ in starts], np.random.default_rng(SEED)
        for b in cuts(batches):
            docs, feats, y, part = _read(b)
            for model, state, p in zip(models, states, left_out, strict=True):
                train = np.flatnonzero(part != p)
                for _ in range(passes):
                    rng.shuffle(train)
                    for batch in _batches(train, docs):
                        _step(model, state, [docs[j] for j in batch], feats, y[batch], weights[y[batch]])
        for i, (model, start, state) in enumerate(zip(models, starts, states, strict=True)):
            at = np.flatnonzero(state["emb"] > FIRST_STEP)
            moved = np.concatenate((model.emb[at] - start.emb[at], (_dense(model) - _dense(start)).reshape(-1, DIM)))
            rows = np.concatenate((at, BUCKETS + np.arange(len(moved) - len(at))))
            steps = np.rint(moved * UNIT).astype(np.int64)
            columns = [pa.array(np.full(len(rows), i, dtype=np.int32)), pa.array(rows.astype(np.int32)), *(pa.array(steps[:, d].copy()) for d in range(DIM))]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "row", *MOVES])

    return kernel


def _batches(train: np.ndarray, docs: list[np.ndarray]):
    """``train`` in batches of ``BATCH`` texts, fewer where these have more than ``BATCH_WORDS`` words."""
    batch, size = [], 0
    for j in train:
        if batch and (len(batch) == BATCH or size + len(docs[j]) > BATCH_WORDS):
            yield np.array(batch)
            batch, size = [], 0
        batch.append(j)
        size += len(docs[j])
    if batch:
        yield np.array(batch)


def _dense(model: Model) -> np.ndarray:
    """All weights but the embeddings, in whole rows of ``DIM``."""
    flat = np.concatenate((model.filters.ravel(), model.bias, model.out, [model.out_bias]))
    return np.concatenate((flat, np.zeros(-len(flat) % DIM)))


def _averaged(labelled: DataFrame, starts: list[Model], left_out: list[int], weights: np.ndarray, rows: int) -> list[Model]:
    """The starts moved by the average of what the tasks say: of an embedding, of those tasks that met it.

    Moves are whole numbers of 1 / ``UNIT``, so that their sums do not hang on an order.
    """
    tasks = -(-rows // TASK_TEXTS)
    passes = min(PASSES, max(1, TASK_TEXTS * tasks // rows))
    kernel = _moved(starts, left_out, weights, passes)
    told = labelled.coalesce(tasks).mapInArrow(kernel, "model int, row int, " + ", ".join(f"{d} bigint" for d in MOVES))
    summed = stored(told.groupBy("model", "row").agg(F.count("*").alias("n"), *(F.sum(d).alias(d) for d in MOVES)), "moves")
    out = []
    for i, start in enumerate(starts):
        found = summed.where(F.col("model") == i).toArrow()
        move = np.zeros((BUCKETS + len(_dense(start)) // DIM, DIM))
        move[found.column("row").to_numpy()] = np.stack([found.column(d).to_numpy() for d in MOVES], axis=1) / found.column("n").to_numpy()[:, None] / UNIT
        dense = _dense(start) + move[BUCKETS:].ravel()
        filters, bias, last, out_bias = np.split(dense[: DIM * ROW + 2 * len(start.bias) + 1], np.cumsum((DIM * ROW, len(start.bias), len(start.out))))
        out.append(Model((start.emb + move[:BUCKETS]).astype(np.float32), filters.reshape(DIM, ROW), bias, last, float(out_bias[0])))
    return out


def _told(labelled: DataFrame, models: list[Model]) -> dict[tuple[str | None, int], tuple[np.ndarray, np.ndarray]]:
    """For each language and label: logits by the model without the row's part, in steps of 1 / ``GRID``, and how many of all rows have each."""
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        values, part = texts(b.column(0)), b.column(3).to_numpy()
        z = np.zeros(len(values))
        for p in set(part.tolist()):
            at = np.flatnonzero(part == p)
            z[at] = shared.value[p].logits([values[i] for i in at])
        return pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(np.rint(np.clip(z, -30, 30) * GRID).astype(np.int32))], names=["lang", "toxic", "z"])

    rows = per_batch(labelled, kernel, "lang string, toxic int, z int").groupBy("lang", "toxic", "z").count().toArrow().to_pylist()
    found: dict = {}
    for r in sorted(rows, key=lambda r: r["z"]):
        found.setdefault((r["lang"], r["toxic"]), []).append((r["z"] / GRID, r["count"]))
    return {k: tuple(np.array(x, dtype=float) for x in zip(*v, strict=True)) for k, v in found.items()}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows.

    Rows of the held-out fold and those without an id, a label (0 or 1) or a text are left out;
    all others count, with their whole texts, for the embeddings' evidence, the weights, the
    calibration and the thresholds. Tasks step over their rows from one start and their moves are
    averaged. Without both classes all scores are the one there is, and 0 without any.
    """
    labelled = _labelled(docs, labels)
    count = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return fit([b""] * len(count), list(count), [None] * len(count), [0] * len(count))
    n = np.array([count[0], count[1]], dtype=float)
    holders = _holders(labelled)
    left_out = [*range(PARTS), -1]
    starts = [_start(evidence_of(holders[[q for q in range(PARTS) if q != p]].sum(axis=0), n[1] / n.sum())) for p in left_out]
    *others, model = _averaged(labelled, starts, left_out, n.sum() / (2 * n), int(n.sum()))
    told = _told(labelled, others)
    z, y, weight = (np.concatenate([x[k] for x in ((v[0], np.full(len(v[0]), c), v[1]) for (_, c), v in told.items())]) for k in range(3))
    model.scale, model.shift = _calibrated(z, y, weight)
    for (lang, c), (at, k) in told.items():
        if lang is not None and c == 0 and k.sum() >= LEAST_ROWS:
            least = at[np.searchsorted(np.cumsum(k), (1 - FALSE_SHARE) * k.sum())]
            model.thresholds[lang] = float(min(0.9, max(0.1, 1 / (1 + np.exp(-np.clip(model.scale * least + model.shift, -30, 30))))))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, threshold, flagged for every row of ``docs``.

    ``predicted`` is 1 from a score of one half; ``flagged`` compares with the threshold of the
    row's language (the languages' median, or one half, where there is none). Null and empty
    texts get the score of a text without words. Texts are scored whole; of many long ones only
    about half a megabyte of words, or one text, is held at once. Repeated rows give repeated
    rows, an empty table an empty one; columns but doc_id, text and lang are not looked at, and
    lang sets the threshold only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    default = float(np.median(list(model.thresholds.values()))) if model.thresholds else 0.5

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shared.value.scores(texts(b.column(1))), pa.float64())], names=["doc_id", "lang", "score"])

    found = per_batch(clash_free(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("bigint"), "text", "lang"), kernel, "doc_id bigint, lang string, score double")
    threshold = F.lit(default)
    for lang, t in sorted(model.thresholds.items()):
        threshold = F.when(F.col("lang") == lang, t).otherwise(threshold)
    found = found.withColumn("threshold", threshold)
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged; trained on the other folds.

    A null id is held out of no fold. Edge cases as in ``train`` and ``scored``.
    """
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "threshold", "flagged")
