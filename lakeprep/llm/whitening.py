"""Whitening of embeddings: principal components of all vectors, each scaled to unit variance.

Entries become integers, ``x = floor(1024 * c) + 100000``. Three passes over the table, each a map with one
partial result a task that Spark adds up:

1. count and sums per dimension, exact;
2. the covariance, centred first: with ``m`` the integer part of the mean, the products of ``y = x - m`` are
   added as integers, exactly, whatever the order of tasks; what is left of the mean, below 1, comes off at the
   end. The driver receives the upper triangle, whose size is fixed by the dimension;
3. projection of every row on the components, which travel with the task's code (dimension x components).

The driver decomposes the covariance: Householder reflections to a tridiagonal matrix, Sturm counts and
bisection for the leading eigenvalues, inverse iteration for their vectors. Vectors of close eigenvalues are
orthogonalised against each other in every iteration; components of equal variance are some orthonormal basis
of their space. A last aggregate takes the covariance of the whitened values themselves.

Defined results: vectors that are null or empty, hold null or non-finite entries, or entries beyond
``LARGEST`` take no part; neither do vectors of another length than most (ties: the longer). A null id stays.
Repeated rows count and are returned each. Components without variance are left out, since they cannot be
scaled: one row, or equal rows only, give none. Very long vectors work, at the cost of a square table on the
driver. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, SHIFT, COMPONENTS, LARGEST, ROWS_AT_ONCE = 1024, 100_000, 8, 2.0 ** 40, 4096
#: Sums of products below this are exact in doubles.
_EXACT = 2 ** 53


def _matrices(batch: pa.RecordBatch, column: int, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the usable vectors of a batch, a length at a time, as 64-bit integers."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten()
    entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    ends = np.cumsum(sizes)
    for n in np.unique(sizes[sizes > 0]) if size is None else [size]:
        rows = np.flatnonzero(sizes == n)
        if not len(rows):
            continue
        block = entries[(ends[rows] - n)[:, None] + np.arange(n)]
        good = (np.abs(block) < LARGEST).all(1)                     # false for NaN
        for at in range(0, int(good.sum()), ROWS_AT_ONCE):
            own = np.flatnonzero(good)[at:at + ROWS_AT_ONCE]
            yield rows[own], np.floor(block[own] * SCALE).astype(np.int64) + SHIFT


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer ``a.T @ b``: in doubles where no sum can round, else in Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, len(a))
    if most < _EXACT:
        return (a.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object)
    return a.T.astype(object) @ b.astype(object)


def _decimals(values) -> pa.Array:
    """Integers as decimals; null what 38 digits do not hold."""
    return pa.array([Decimal(int(v)) if abs(v) < 10 ** 38 else None for v in values], pa.decimal128(38, 0))


def sums(df: DataFrame) -> tuple[int, list[int]]:
    """How many vectors of the commonest length there are, and their sums per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch, 0):
                n, total = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = n + len(x), total + x.sum(0).astype(object)
        rows = [(size, place, n, total[place]) for size, (n, total) in found.items() for place in range(size)]
        for at in range(0, len(rows), 10_000):
            size, place, n, total = zip(*rows[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), _decimals(total)],
                                             ["size", "place", "n", "total"])

    parts = df.select("vector").mapInArrow(run, "size long, place long, n long, total decimal(38,0)")
    sizes = parts.where(F.col("place") == 0).groupBy("size").agg(F.sum("n").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return 0, []
    found = parts.where(F.col("size") == top["size"]).groupBy("place").agg(F.sum("total").alias("total")).collect()
    return top["n"], [int(r["total"]) for r in sorted(found, key=lambda r: r["place"])]


def covariance(df: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the vectors of ``len(total)`` entries, divisor ``n``."""
    size = len(total)
    middle = np.array([t // n for t in total], np.int64)
    row, col = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            for _, x in _matrices(batch, 0, size):
                held = held + _dot(x - middle, x - middle)
        if isinstance(held, np.ndarray):
            for at in range(0, len(row), 10_000):
                r, c = row[at:at + 10_000], col[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(r * size + c, pa.int64()), _decimals(held[r, c])], ["cell", "value"])

    cells = (df.select("vector").mapInArrow(run, "cell long, value decimal(38,0)")
             .groupBy("cell").agg(F.sum("value").alias("value")).collect())        # size * (size + 1) / 2 rows
    rest = [t - n * int(m) for t, m in zip(total, middle)]                         # n times what is left of the mean
    out = np.zeros((size, size))
    for cell in cells:
        i, j = divmod(cell["cell"], size)
        # (sum of products - rest * rest / n) / n, rounded once
        out[i, j] = out[j, i] = (int(cell["value"]) * n - rest[i] * rest[j]) / (n * n)
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that bring a symmetric matrix to that form."""
    a, size, mirrors = matrix.astype(np.float64).copy(), len(matrix), []
    for k in range(size - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if length > 0:
            v[0] += length if v[0] >= 0 else -length
            v /= np.linalg.norm(v)
            block = a[k + 1:, k + 1:]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -length if a[k + 1, k] >= 0 else length
            a[k + 2:, k] = a[k, k + 2:] = 0
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of the shifted matrix (Sturm count)."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps * max(1.0, float(np.max(off ** 2, initial=0)))
    counts, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        counts += pivot < 0
    return counts


def leading_values(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` largest eigenvalues, falling, each bisected until its bracket closes."""
    size = len(diagonal)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = float(np.min(diagonal - reach)), float(np.max(diagonal + reach))
    slack = 2 * np.finfo(np.float64).eps * max(abs(low), abs(high))
    rank = size - np.arange(many)                                   # the k-th largest has size - k - 1 below it
    lo, hi = np.full(many, low - slack), np.full(many, high + slack)
    while True:
        middle = (lo + hi) / 2
        todo = (middle > lo) & (middle < hi)
        if not todo.any():
            return middle
        under = below(diagonal, off, middle) >= rank
        hi, lo = np.where(todo & under, middle, hi), np.where(todo & ~under, middle, lo)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """Solve the shifted tridiagonal system by elimination with row exchanges."""
    size, b = len(diagonal), b.copy()
    scale = max(float(np.max(np.abs(diagonal), initial=0)), float(np.max(np.abs(off), initial=0)))
    least = np.finfo(np.float64).eps * (scale or 1.0)
    main, up = diagonal - value, np.append(off, 0.0)
    second = np.zeros(size)
    for i in range(size - 1):
        under = off[i]
        if abs(main[i]) >= abs(under):
            if main[i] == 0:
                main[i] = least
            factor = under / main[i]
            main[i + 1] -= factor * up[i]
            b[i + 1] -= factor * b[i]
        else:                                                       # the lower row comes first
            factor = main[i] / under
            old_up = up[i]
            main[i], up[i] = under, main[i + 1]
            main[i + 1] = old_up - factor * up[i]
            second[i], up[i + 1] = up[i + 1], -factor * up[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
    if abs(main[-1]) < least:
        main[-1] = least
    x = np.zeros(size)
    for i in range(size - 1, -1, -1):
        rest = b[i] - (up[i] * x[i + 1] if i + 1 < size else 0.0) - (second[i] * x[i + 2] if i + 2 < size else 0.0)
        x[i] = rest / main[i]
        if abs(x[i]) > 1e200:
            x, b = x * 1e-200, b * 1e-200
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling ``values`` by inverse iteration, orthogonal within clusters."""
    size = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal), initial=0)), float(np.max(np.abs(off), initial=0))) or 1.0
    random, out, cluster = np.random.default_rng(12), np.zeros((size, len(values))), 0
    shift = 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        # equal values get slightly different shifts, so that their systems differ
        shift = value if k == cluster else min(value, shift - 10 * np.finfo(np.float64).eps * norm)
        x = random.standard_normal(size)
        for _ in range(5):
            near = out[:, cluster:k]
            x -= near @ (near.T @ x)
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    many = min(many, len(matrix))
    if not many:
        return np.zeros(0), np.zeros((0, 0))
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, many)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):                       # back from the tridiagonal form
        v = mirrors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values, vectors


def project(df: DataFrame, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``(id, deviation, whitened)`` of every row of the fit list."""
    size = len(total)
    middle = np.array([t // n for t in total], np.int64)
    rest = np.array([t - n * (t // n) for t in total], object)      # 0 to n - 1
    small, scaled = np.array([r / n for r in rest], np.float64), vectors / np.sqrt(values)
    rest_square = int((rest * rest).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch, 1, size):
                y = x - middle
                # (n x - S)^2 = (n y - rest)^2, in integers of any size
                wide = float(np.abs(y).max(initial=0)) * max(float(np.abs(y).max(initial=0)), n) * size >= 2 ** 62
                y_wide, r_wide = (y.astype(object), rest) if wide else (y, rest.astype(np.int64))
                squares, cross = (y_wide * y_wide).sum(1), y_wide @ r_wide
                deviation = [n * n * int(s) - 2 * n * int(c) + rest_square for s, c in zip(squares, cross)]
                white = (y - small) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), _decimals(deviation),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))],
                    ["id", "deviation", "whitened"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "vector").mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is a decimal of 38 digits (null if it needs more); ``identity_error`` is measured on the whitened values returned.
    """
    own = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    n, total = sums(own)
    values, vectors, trace = np.zeros(0), np.zeros((len(total), 0)), 1.0
    if n:
        matrix = covariance(own, n, total)
        trace = float(np.trace(matrix))
        values, vectors = leading(matrix, components)
        with_variance = values > 64 * np.finfo(np.float64).eps * max(trace, np.finfo(np.float64).tiny)
        values, vectors = values[with_variance], vectors[:, with_variance]
    many = len(values)
    rows = project(own if many else own.limit(0), max(n, 1), total, values, vectors)
    if not many:                                                    # no variance: nothing to return, the columns stay
        rows = rows.where(F.lit(False))
    rows = stage(rows, "whitened")
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    error = 0.0
    if pairs:
        found = rows.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
        error = max(abs(found[k] - (i == j)) for k, (i, j) in enumerate(pairs))
    share = F.array(*[F.lit(float(v / trace)) for v in values]) if many else F.array().cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode(F.arrays_zip("whitened", share.alias("share"))).alias("place", "both"))
    return each.select(F.col("id").alias(key), (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                       "deviation", F.col("both.whitened").alias("whitened"), F.col("both.share").alias("explained"),
                       F.lit(float(error)).alias("identity_error"))
