"""Whitening of embeddings: principal components of all vectors, and every vector in their coordinates.

Vectors are whole numbers, floor(scale * c) + shift. Spark sums them and, in a second pass, the products of
what is left after the mean is taken away; both are exact while they stay below 2**53, so results don't depend
on how rows were dealt. The driver gets one number for each pair of dimensions and finds the leading
components there: Householder reflections to tridiagonal form, bisection on Sturm counts for eigenvalues,
inverse iteration with reorthogonalisation among close ones for vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Whole numbers up to here are exact in a double.
EXACT = 2.0**53


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors of a symmetric matrix; vector k acts on rows k + 1 and below."""
    a = matrix.astype(np.float64).copy()
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        v = np.zeros_like(x)
        if size > 0 and np.abs(x[1:]).max() > 0:
            v = x / size
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = 2 * rest @ v
            w = p - (v @ p) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are less than each number."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = np.concatenate([[0.0], off**2])
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for d, e2 in zip(diagonal, squares, strict=True):
        q = d - at - e2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each halved down to the last bit between bounds from Gershgorin's circles."""
    n = len(diagonal)
    radius = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    spread = np.abs([low[0], high[0]]).max() * 4 * np.finfo(float).eps
    low, high = low - spread, high + spread
    above = np.arange(1, k + 1)  # eigenvalue number i is where i are at least as large
    for _ in range(2100):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        enough = n - sturm_counts(diagonal, off, middle) >= above
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return low


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right by elimination with row exchanges; pivots of 0 become `least`."""
    n = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    lower, x = off.tolist(), right.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            main[i], lower[i] = lower[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if main[i] == 0:
            main[i] = least
        part = lower[i] / main[i]
        main[i + 1] -= part * upper[i]
        upper[i + 1] -= part * second[i]
        x[i + 1] -= part * x[i]
    for i in range(n - 1, -1, -1):
        if abs(main[i]) < least:
            main[i] = least if main[i] >= 0 else -least
        known = (upper[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - known) / main[i]
    return np.array(x)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows, largest entry positive."""
    n = len(matrix)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if scale == 0:
        return np.zeros(min(k, n)), np.eye(n)[: min(k, n)]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(k, n))
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0))
    least, close = np.finfo(float).eps * norm, 1e-3 * norm
    vectors: list[np.ndarray] = []
    start = np.random.default_rng(1)  # start vectors only; what they converge to doesn't depend on them
    shift = np.inf
    for i, value in enumerate(values):
        shift = min(value, shift - least)  # equal eigenvalues are told apart by a rounding error
        near = [vectors[j] for j in range(i) if values[j] - value <= close]
        y = start.normal(size=n)
        for _ in range(5):
            y = solve_shifted(diagonal, off, shift, y / np.linalg.norm(y), least)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in near:
                    y -= (other @ y) * other
            y /= np.linalg.norm(y)
        vectors.append(y)
    out = []
    for y in vectors:
        y = y.copy()
        for j in range(len(reflectors) - 1, -1, -1):
            v = reflectors[j]
            y[j + 1 :] -= 2 * v * (v @ y[j + 1 :])
        y /= np.linalg.norm(y)
        out.append(y if y[np.abs(y).argmax()] > 0 else -y)
    return values * scale, np.array(out)


def whole_vectors(column: pa.Array, dimensions: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, and their whole numbers; see whiten() for the rows that don't."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((lengths == dimensions) & pc.is_valid(column).to_numpy(zero_copy_only=False))
    places = (np.cumsum(lengths) - lengths)[rows]
    found = np.floor(scale * values[places[:, None] + np.arange(dimensions)])
    good = (np.abs(found) < EXACT).all(axis=1)  # false for what isn't finite
    return rows[good], found[good].astype(np.int64) + shift


def sums_of(vectors: DataFrame, d: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension; high and low halves are summed apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            _, x = whole_vectors(batch.column(1), d, scale, shift)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    rows = vectors.mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(exact("n"), exact("high"), exact("low")).orderBy("i").collect()
    return (int(rows[0][1]) if rows else 0), [(int(r[2]) << 32) + int(r[3]) for r in rows]


def product_sums(rows: DataFrame, d: int, numbers) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of all pairs of columns, and of the columns, of the matrices that numbers() makes of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            z = numbers(batch)
            products += z.T @ z
            sums += z.sum(axis=0)
        i, j = np.triu_indices(d)
        i, j, v = np.concatenate([i, np.arange(d)]), np.concatenate([j, np.full(d, -1)]), np.concatenate([products[i, j], sums])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], ["i", "j", "v"])

    out, sums = np.zeros((d, d)), np.zeros(d)
    for i, j, v in rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        if j < 0:
            sums[i] = v
        else:
            out[i, j] = out[j, i] = v
    return out, sums


def whiten(rows: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """Every vector in the whitened coordinates of the leading principal components: id, component (from 1), n, deviation
    (exact, decimal), whitened, explained, identity_error (the largest entry of whitened's covariance less the identity).

    Rows with a null vector, a null or non-finite entry, or one too large for a double's whole numbers are dropped, as are
    vectors of another length than most of the others have (ties: the longest). Null ids, repeated rows and ties stay rows
    of their own; other columns aren't read. Components without variance (all vectors equal, fewer vectors than dimensions)
    have no whitening and aren't returned; an empty table gives an empty one. A deviation beyond 38 digits is null.
    Three passes of sums, no shuffle but theirs; the driver and the broadcast hold as many numbers as there are pairs of dimensions.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    vectors = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    out_schema = f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    usual = vectors.filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) < EXACT))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual.d if usual else 0
    n, sums = sums_of(vectors, d, scale, shift) if d else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], out_schema)
    # The whole part of the mean is taken away first, so products stay whole numbers; what is left of it is under 1.
    floors, rests = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    products, left = product_sums(vectors, d, lambda b: (whole_vectors(b.column(1), d, scale, shift)[1] - floors).astype(np.float64))
    covariance = (products - np.outer(left, left) / n) / n
    total = float(np.trace(covariance))
    values, axes = leading_components(covariance, min(components, d))
    some = values > d * np.finfo(float).eps * total
    values, axes = values[some], axes[some]
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], out_schema)
    project = axes.T / np.sqrt(values)
    said = rows.sparkSession.sparkContext.broadcast((floors, rests, project))

    def whitened(x: np.ndarray) -> np.ndarray:
        floors, rests, project = said.value
        return ((x - floors).astype(np.float64) - rests / n) @ project

    squares, means = product_sums(vectors, k, lambda b: whitened(whole_vectors(b.column(1), d, scale, shift)[1]))
    error = float(np.abs(squares / n - np.outer(means / n, means / n) - np.eye(k)).max())
    explained = values / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors, rests, _ = said.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                kept, x = whole_vectors(part.column(1), d, scale, shift)
                if not len(kept):
                    continue
                z = x - floors
                most = (int(np.abs(z).max()) + 1) * n
                if d * most * most < 2**63:
                    deviation = pa.array(((n * z - rests) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:  # the same in numbers of any size
                    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rests.tolist(), strict=True)) for row in z.tolist()]
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                again = np.repeat(np.arange(len(kept)), k)
                columns = [part.column(0).take(pa.array(kept)).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))), pa.array(np.full(len(again), n)), deviation.take(pa.array(again))]
                columns += [pa.array(whitened(x).ravel()), pa.array(np.tile(explained, len(kept))), pa.array(np.full(len(again), error))]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, out_schema)
