"""Whitening against numpy's own eigenvectors, and its parts on hard matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.llm.registry import QUERIES
from paylens.llm.whitening import leading_components, leading_eigenvalues, sturm_counts, tridiagonal, whiten


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)) + 100_000
    n, centred = len(x), x - x.mean(axis=0)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    whole = np.array([[int(v) for v in row] for row in x], object)
    deviation = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    return centred @ axes / np.sqrt(values), deviation, values / np.trace(covariance)


def compare(got, ids, vectors, k=8, close=1e-9):
    whitened, deviation, explained = brute(vectors, k)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == len(ids) * whitened.shape[1]
    mine = np.array([[rows[i, c + 1].whitened for c in range(whitened.shape[1])] for i in ids])
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * signs - whitened).max() < close
    for at, i in enumerate(ids):
        for c in range(whitened.shape[1]):
            r = rows[i, c + 1]
            assert int(r.deviation) == deviation[at] and r.n == len(ids)
            assert math.isclose(r.explained, explained[c], rel_tol=1e-9) and 0 <= r.identity_error < 1e-9


def test_the_query_as_numpy_does_it(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows_are_left_out_and_others_kept(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(100, [0.5] * 5), (101, [0.5] * 5)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [math.nan] * 5), (53, [math.inf, 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "component": F.lit(2)}).repartition(6)
    compare(whiten(df).collect(), [i for i, _ in good], [v for _, v in good])
    twice = whiten(df.filter("vec_id = 3").unionByName(df.filter("vec_id <> 52 or vec_id is null")).withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id"))))
    assert twice.count() == 43 * 5 and twice.filter("vec_id is null").count() == 5


def test_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert df.collect() == [] and df.columns[0] == "vec_id"
    two = whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(30, 3)) * [1e11, 1e9, 1.0]).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    compare(whiten(df, components=2).collect(), range(30), vectors, k=2, close=1e-6)


@pytest.mark.parametrize("kind", ["random", "equal", "blocks", "clusters", "diagonal", "rank one", "graded", "pair"])
def test_components_of_hard_matrices(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    m = {
        "random": lambda: q @ np.diag(rng.random(40)) @ q.T, "equal": lambda: q @ np.diag([5.0] * 10 + [1.0] * 30) @ q.T, "blocks": lambda: np.kron(np.eye(10), np.ones((4, 4))),
        "clusters": lambda: q @ np.diag([1 + 1e-13 * i for i in range(20)] + [0.5] * 20) @ q.T, "diagonal": lambda: np.diag([3.0, 3.0, 2.0, 7.0]), "rank one": lambda: np.outer(q[0], q[0]),
        "graded": lambda: np.diag(10.0 ** -np.arange(12)) + 1e-9, "pair": lambda: np.array([[2.0, 1.0], [1.0, 2.0]]),
    }[kind]()
    m = (m + m.T) / 2
    values, axes = leading_components(m, 8)
    k = min(8, len(m))
    assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:k]).max() < 1e-13 * max(1, np.abs(m).max() * len(m))
    assert np.abs(axes @ axes.T - np.eye(k)).max() < 1e-12
    assert np.abs(m @ axes.T - axes.T * values).max() < 1e-12 * len(m)


def test_the_steps_of_the_eigenvalues():
    rng = np.random.default_rng(6)
    m = rng.normal(size=(25, 25))
    m = m + m.T
    diagonal, off, reflectors = tridiagonal(m)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    exact = np.linalg.eigvalsh(m)
    assert np.allclose(np.linalg.eigvalsh(t), exact, atol=1e-12) and len(reflectors) == 23
    assert sturm_counts(diagonal, off, np.array([exact[0] - 1, (exact[3] + exact[4]) / 2, exact[-1] + 1])).tolist() == [0, 4, 25]
    assert np.allclose(leading_eigenvalues(diagonal, off, 5), exact[::-1][:5], atol=1e-12)
