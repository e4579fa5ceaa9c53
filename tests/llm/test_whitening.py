"""Whitening against a dense eigensolver and exact integers."""

import math

import duckdb
import numpy as np
import pytest

from starledger.llm import queries, whitening

from .test_operators import SF, odd


@pytest.mark.parametrize("d, n", [(64, 500), (64, 40), (5, 3), (1, 10), (2, 9)])
def test_components_of_random_matrices(d, n):
    x = np.random.default_rng(d + n).normal(size=(n, d)) * 10
    x -= x.mean(axis=0)
    v = x.T @ x / n
    values, vectors = whitening.leading_components(v)
    e, u = np.linalg.eigh(v)
    k = min(32, d, np.linalg.matrix_rank(v))
    assert len(values) == k and np.allclose(values, e[::-1][:k], rtol=1e-10)
    assert np.allclose(np.abs((vectors * u[:, ::-1][:, :k]).sum(axis=0)), 1, atol=1e-9)


@pytest.mark.parametrize("v", [np.eye(40), np.diag([3.0, 3, 3, 2, 2, 1]), np.ones((6, 6)), np.kron(np.diag([5.0, 5, 1]), np.eye(8) + 0.1)])
def test_components_of_equal_eigenvalues(v):
    values, vectors = whitening.leading_components(v)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert len(whitening.leading_components(np.zeros((4, 4)))[0]) == 0


def brute(rows):
    """(id, deviation, whitened row) of every row, with Python integers and a dense solver."""
    x = [[math.floor(64 * c) + 1000000 for c in map(float, v)] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    keep = e > len(e) * 1e-15 * e[0]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return deviations, z @ u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(cov)


def test_stored_embeddings(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF}/embeddings.parquet')").fetchall()
    deviations, white, explained = brute(rows)
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == len(rows) * 32
    for i, (vec, _) in enumerate(rows):
        assert got[vec, 1].deviation == deviations[i] and got[vec, 1].n == len(rows)
    for c in range(32):
        mine = np.array([got[vec, c + 1].whitened for vec, _ in rows])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-7
        assert abs(got[0, c + 1].explained / explained[c] - 1) < 1e-8
    assert {r.identity_error for r in got.values()} == {got[0, 1].identity_error} and got[0, 1].identity_error < 1e-9


def test_odd_vectors(spark):
    """Nulls, infinities and other lengths go; ids may be null or repeated; other columns do not matter."""
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [3.0, -2.0]), (3, [-1e3, 2.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [-1e30, 7.0])]
    schema = "vec_id bigint, embedding array<double>, label int"
    df = odd(spark.createDataFrame([(*r, 0) for r in rows], schema))
    got = whitening.whiten(df).collect()
    # beside an entry of -1e30 the other direction is beyond double precision: one component
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "10", "3", "None"]
    assert all(r.deviation is None for r in got if r.vec_id == 10)  # beyond a long
    plain = [r for r in rows if r[0] in (1, None, 3)]
    deviations, white, explained = brute(plain)
    got = whitening.whiten(df.where("vec_id is null or vec_id in (1, 3, 4, 5, 6, 7, 8, 9)")).collect()
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(np.abs(white).ravel()), atol=1e-8)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, schema)
    for none in (one, one.where("false"), df.where("vec_id in (4, 5, 6)")):
        out = whitening.whiten(none)
        assert out.columns == [c.split()[0] for c in whitening.REPORT.split(", ")] and out.count() == 0


def test_sums_do_not_depend_on_the_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = whitening.fit(df.repartition(1)), whitening.fit(df.repartition(13))
    assert a.sums == b.sums and np.allclose(a.values, b.values, rtol=1e-12) and b.identity_error < 1e-9
