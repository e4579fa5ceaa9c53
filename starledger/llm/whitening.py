"""Whitening of embeddings by the leading components of their covariance.

The table is read by tasks that keep one matrix each: sums of the vectors first, then products
of the centred vectors, which meet by a tree of sums whose last step is bounded by the square of
the dimension, not by rows. The covariance so gathered, one matrix of dimension squared, is
taken apart on the driver: Householder reflections bring it to tridiagonal form, Sturm counts
bisect the leading eigenvalues, inverse iteration finds their vectors, made orthogonal again
within clusters of near eigenvalues, and the reflections carry them back. The components are
broadcast, and a pass over the table projects every vector; how far the result is from white is
measured by one pass more.

Entries become integers before anything else, so sums and deviations are exact. The offset that
all entries share leaves n x - S and x - S / n as they are, so kernels work without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clash_free, cuts

#: Fixed by the contract: x = floor(SCALE * c) and an offset, and the most components.
SCALE, COMPONENTS = 64.0, 32
#: Matrices that reach the driver take about this many bytes together.
GATHERED_BYTES = 1 << 25
#: Entries whose scaled value a long of 64 bits cannot hold are cut to this one: far beyond any embedding.
LARGEST = float(1 << 52)
#: Eigenvalues closer than this share of the spectrum's width form a cluster.
CLUSTER = 1e-3
REPORT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# the eigenproblem of one symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and the Householder vectors that bring a symmetric matrix to them."""
    a, n, mirrors = matrix.astype(float).copy(), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.abs(x[1:]).max(initial=0.0)
        if rest == 0.0:
            continue
        top = max(rest, abs(x[0]))
        x /= top
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        # two-sided reflection as one update of rank two
        p = 2.0 * (a[k + 1 :, k + 1 :] @ v)
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        column = a[k + 1 :, k] - 2.0 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = column
        mirrors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number of ``at``, how many eigenvalues of the tridiagonal matrix are below it."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    square, below, q = e * e, np.zeros(len(at), dtype=np.int64), d[0] - at
    with np.errstate(over="ignore"):
        for i in range(len(d)):
            if i:
                q = d[i] - at - square[i - 1] / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bounds are neighbouring numbers."""
    n = len(d)
    reach = np.abs(np.concatenate((e, [0.0]))) + np.abs(np.concatenate(([0.0], e)))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    low, high = low - 1e-12 * (1 + np.abs(low)), high + 1e-12 * (1 + np.abs(high))
    rank = n - 1 - np.arange(k)  # the largest has n - 1 eigenvalues below it
    for _ in range(200):
        middle = 0.5 * (low + high)
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_counts(d, e, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def _shifted(d: np.ndarray, e: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) y = b: elimination with row exchanges, done once."""
    n = len(d)
    main, upper, second = d - shift, np.concatenate((e, [0.0])), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, dtype=bool)
    floor = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    for i in range(n - 1):
        below = (e[i], main[i + 1], upper[i + 1])
        if abs(below[0]) > abs(main[i]):
            swapped[i] = True
            mine = (main[i], upper[i])
            main[i], upper[i], second[i] = below
            factor[i] = mine[0] / main[i]
            main[i + 1], upper[i + 1] = mine[1] - factor[i] * upper[i], -factor[i] * second[i]
        else:
            main[i] = main[i] if abs(main[i]) > floor else np.copysign(floor, main[i])
            factor[i] = below[0] / main[i]
            main[i + 1] = below[1] - factor[i] * upper[i]
    main[-1] = main[-1] if abs(main[-1]) > floor else np.copysign(floor, main[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            y[i] = (y[i] - (upper[i] * y[i + 1] if i + 1 < n else 0.0) - (second[i] * y[i + 2] if i + 2 < n else 0.0)) / main[i]
        return y

    return solve


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, by inverse iteration."""
    n, found, rng = len(d), np.zeros((len(d), len(values))), np.random.default_rng(7)
    width = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * width:
            first = j
        # equal eigenvalues: another shift each, or all would find one vector
        shift = value - (j - first) * 4 * np.finfo(float).eps * width
        solve, y = _shifted(d, e, shift), rng.standard_normal(n)
        for _ in range(6):
            y = solve(y)
            y /= np.abs(y).max()
            for _twice in range(2):
                near = found[:, first:j]
                y -= near @ (near.T @ y)
            y /= np.linalg.norm(y)
        found[:, j] = y
    return found


def leading_components(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive matrix, falling, and their unit vectors as columns.

    Values that rounding alone may have made (dimension times the precision of the largest) are
    no components: what is projected on them could not be divided by their roots.
    """
    n = len(matrix)
    if n == 0 or not np.any(matrix):
        return np.zeros(0), np.zeros((n, 0))
    d, e, mirrors = tridiagonal(matrix)
    values = leading_values(d, e, min(most, n))
    values = values[values > n * np.finfo(float).eps * max(values[0], 0.0)]
    vectors = leading_vectors(d, e, values)
    for start, v in reversed(mirrors):
        vectors[start:] -= 2.0 * np.outer(v, v @ vectors[start:])
    return values, vectors / np.linalg.norm(vectors, axis=0)


# passes over the table


def _usable() -> Column:
    return F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _usual_length(vectors: DataFrame) -> int:
    """The length that most usable vectors have, the larger of two alike; 0 without any."""
    sizes = vectors.where(_usable()).groupBy(F.size("embedding").alias("d")).count().where("d > 0")
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first.d if first else 0


def whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their entries as whole numbers without the offset, one row each.

    A row counts if its vector has ``dim`` entries, all of them finite.
    """
    keep = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(keep)).flatten()
    entries = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(entries).all(axis=1)
    keep[np.flatnonzero(keep)[~finite]] = False
    scaled = np.floor(np.clip(entries[finite] * SCALE, -LARGEST, LARGEST))
    return keep, scaled.astype(np.int64)


def _gathered(vectors: DataFrame, dim: int, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray], None], kind: type = float) -> np.ndarray:
    """The sum over all tasks of the array of ``shape`` that ``add`` fills from whole numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for b in cuts(batches):
            _, x = whole_numbers(b.column(0), dim)
            if len(x):
                add(total, x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py(), dtype=kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    most = max(1, min(64, GATHERED_BYTES // max(1, 8 * int(np.prod(shape)))))
    parts = vectors.select("embedding").mapInArrow(partial, "sums binary").repartition(most).mapInArrow(joined, "sums binary")
    return sum((np.frombuffer(r.sums, dtype=kind).reshape(shape) for r in parts.collect()), np.zeros(shape, dtype=kind))


class Whitening:
    """What the projection needs: counts, sums, components and how white the result is."""

    def __init__(self, dim: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.dim, self.n, self.sums, self.values, self.vectors, self.trace = dim, n, sums, values, vectors, trace
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the whole part taken off exactly first."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, exact; null where a long cannot hold it."""
        sums = np.array(self.sums, dtype=object)
        apart = max((max(abs(self.n * int(x[:, j].max()) - s), abs(self.n * int(x[:, j].min()) - s)) for j, s in enumerate(self.sums)), default=0) if len(x) else 0
        small = apart * apart * max(1, self.dim) < 1 << 62 and self.n * max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) < 1 << 62
        if small:
            away = self.n * x - sums.astype(np.int64)
            return (away * away).sum(axis=1).tolist()
        away = self.n * x.astype(object) - sums
        return [d if d < 1 << 63 else None for d in (away * away).sum(axis=1)]


def fit(embeddings: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table with the column ``embedding``; None if no vector is usable."""
    vectors = clash_free(embeddings, "embedding")
    dim = _usual_length(vectors)
    if not dim:
        return None

    def sums(total: np.ndarray, x: np.ndarray) -> None:
        # high and low halves apart, so that no count of rows overflows a long
        total[0, 0] += len(x)
        total[1] += (x >> 26).sum(axis=0)
        total[2] += (x & ((1 << 26) - 1)).sum(axis=0)

    counted = _gathered(vectors, dim, (3, dim), sums, np.int64)
    n = int(counted[0, 0])
    whole = [(int(h) << 26) + int(low) for h, low in zip(counted[1], counted[2], strict=True)]
    model = Whitening(dim, n, whole, np.zeros(0), np.zeros((dim, 0)), 0.0)

    def products(total: np.ndarray, x: np.ndarray, model: Whitening = model) -> None:
        z = model.centred(x)
        total += z.T @ z

    covariance = _gathered(vectors, dim, (dim, dim), products) / n
    values, components = leading_components((covariance + covariance.T) / 2, most)
    fitted = Whitening(dim, n, whole, values, components, float(np.trace(covariance)))
    k = len(values)

    def seconds(total: np.ndarray, x: np.ndarray, model: Whitening = fitted) -> None:
        w = model.whitened(x)
        total[:k] += w.T @ w
        total[k] += w.sum(axis=0)

    if k:
        moments = _gathered(vectors, dim, (k + 1, k), seconds) / n
        spread = moments[:k] - np.outer(moments[k], moments[k])
        fitted.identity_error = float(np.abs(spread - np.eye(k)).max())
    return fitted


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    A null vector, one with null or non-finite entries, or of another length than most have, is
    left out of the fit and of the result; so are empty vectors. Null and repeated ids stay as
    they are. Directions in which all vectors agree are no components: a table of one vector,
    or of equal ones, gives no rows, as does an empty one. Other columns are not looked at.
    """
    spark, model = embeddings.sparkSession, fit(embeddings, most)
    if model is None or not len(model.values):
        return spark.createDataFrame([], REPORT)
    sent = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k, share = len(m.values), m.values / m.trace
        for b in cuts(batches):
            keep, x = whole_numbers(b.column(1), m.dim)
            rows, w = len(x), m.whitened(x)
            each = lambda a, kind: pa.array(np.repeat(a, k), kind)  # noqa: B023, E731
            ids = b.column(0).filter(pa.array(keep)).take(pa.array(np.repeat(np.arange(rows), k)))
            deviation = pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            number = pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32())
            columns = [ids, number, each(np.full(rows, m.n), pa.int64()), deviation, pa.array(w.ravel()), pa.array(np.tile(share, rows)), each(np.full(rows, m.identity_error), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in REPORT.split(", ")])

    rows = clash_free(embeddings, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    return rows.mapInArrow(project, REPORT)
