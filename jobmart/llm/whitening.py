"""Whitening of embeddings on the leading eigenvectors of their covariance, found by FEAST.

Spark takes the integer vectors, their distinct list, its sums and its centred second moments;
the d x d covariance is all that reaches the driver. There a contour integral finds the leading
eigenpairs: inertia counts of shifted matrices place an interval around them, quadrature of
complex shifted solves projects a block onto their space, and Rayleigh-Ritz extracts them. As
many pairs as the inertia counted must converge, so none is missed.

Rows whose vector is null, holds null or non-finite entries, or is shorter than the longest are
left out. Repeated vectors count once in the fit and each repeated row is returned; null ids and
further columns of any name do no harm. Components with no variance are not returned, so a table
without rows, with one vector or with constant vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmart.llm.common import materialize, ready

SCALE = 256
NODES = 16
ROUNDS = 60
#: Eigenvalues below this share of the trace count as no variance.
NOISE = 1e-12
#: Neighbouring eigenvalues closer than this share of the norm share an interval.
CLOSE = 1e-7


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of a symmetric elimination
    (Sylvester's law), with pivots of one or two rows so that no small pivot is divided by."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        pivot = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        if abs(a[pivot, pivot]) >= 0.5 * off.max(initial=0.0) or len(a) == 1:
            rows = [pivot]
            above += int(a[pivot, pivot] > 0)
        else:
            # a block of two rows around the largest entry has one eigenvalue of each sign
            rows = sorted(int(i) for i in np.unravel_index(int(off.argmax()), off.shape))
            above += int((np.linalg.eigvalsh(a[np.ix_(rows, rows)]) > 0).sum())
        rest = [i for i in range(len(a)) if i not in rows]
        block, side = a[np.ix_(rows, rows)], a[np.ix_(rest, rows)]
        if not block.any():
            return above  # nothing is left but zeros
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return above


def enclosed(matrix: np.ndarray, rank: int, norm: float) -> tuple[float, float]:
    """An interval that holds the eigenvalue number ``rank`` from above, by bisection."""
    low, high = -norm, norm
    while high - low > CLOSE / 8 * norm:
        middle = (low + high) / 2
        if inertia_above(matrix, middle) >= rank:
            low = middle
        else:
            high = middle
    return low, high


def feast(matrix: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs between ``low`` and ``high``, by falling eigenvalue."""
    size, expected = len(matrix), inertia_above(matrix, low) - inertia_above(matrix, high)
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi * (1 + points) / 2)
    width = min(size, 2 * expected + 4)
    block = np.random.default_rng(0).standard_normal((size, width))
    norm = np.abs(matrix).sum(axis=1).max()
    unit = np.eye(size)
    best = None
    for _ in range(ROUNDS):
        projected = np.zeros((size, width))
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * unit - matrix, block)
            projected += weight / 2 * (radius * turn * solved).real
        basis, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ inner
        inside = (values > low) & (values < high)
        if inside.sum() == expected:
            kept = block[:, inside]
            error = np.abs(matrix @ kept - kept * values[inside]).max(initial=0.0)
            if best is not None and error >= best[0] / 2 and best[0] < 1e-11 * norm:
                break
            if best is None or error < best[0]:
                best = error, values[inside], kept
    if best is None or best[0] > 1e-9 * norm:
        raise ArithmeticError("eigenpairs counted by inertia were not all found")
    order = np.argsort(-best[1])
    return best[1][order], best[2][:, order]


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues with unit vectors, fewer if the rest is no variance."""
    trace = np.trace(matrix)
    if not len(matrix) or trace <= 0:
        return np.empty(0), np.empty((len(matrix), 0))
    norm = 1.01 * np.abs(matrix).sum(axis=1).max()
    last = min(count, inertia_above(matrix, NOISE * trace))
    floor = enclosed(matrix, last, norm)[0]
    # the interval must not end inside a cluster of equal eigenvalues
    while last < len(matrix):
        following = enclosed(matrix, last + 1, norm)
        if floor - following[1] > CLOSE * norm:
            floor = (floor + following[1]) / 2
            break
        last, floor = last + 1, following[0]
    else:
        floor = -norm
    values, vectors = feast(matrix, floor, norm)
    kept = (values > NOISE * trace)[:count]
    return values[:count][kept], vectors[:, :count][:, kept]


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` finds: exact sums, vectors as columns by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - (self.sums / self.n).astype(np.float64)) @ self.vectors / np.sqrt(self.values)


def integer_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``x``, the vector in steps of 1 / 256 as longs."""
    entries = F.col(f"`{vector}`")
    finite = F.forall(entries, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))))
    used = rows.where(entries.isNotNull() & F.coalesce(finite, F.lit(False)))
    x = F.transform(entries, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    return used.select(*rows.columns, x.alias("_x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _moments(size: int, mean: np.ndarray, batches: Iterator[pa.RecordBatch]):
    """A row of sums of products for each dimension, from all centred vectors of the task."""
    total = np.zeros((size, size))
    for batch in batches:
        centred = _matrix(batch.column(0), size) - mean
        total += centred.T @ centred
    rows = [pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(rows, names=["i", "row"])


def second_moments(vectors: DataFrame, size: int, mean: np.ndarray) -> np.ndarray:
    """Sums of products of ``vectors`` (column ``x``) less ``mean``; size x size numbers reach
    the driver."""
    parts = vectors.select("x").mapInArrow(
        lambda b: _moments(size, mean, b), "i long, row array<double>"
    )
    cells = parts.select("i", F.posexplode("row").alias("j", "value"))
    summed = cells.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    matrix = np.zeros((size, size))
    matrix[summed["i"].astype(int), summed["j"].astype(int)] = summed["value"]
    return (matrix + matrix.T) / 2


def fit(fit_list: DataFrame, components: int) -> Whitening | None:
    """The whitening of a list of distinct vectors (column ``x``); None for an empty list."""
    size = fit_list.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    sums = fit_list.agg(
        F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(size)]
    ).first()
    n, total = sums[0], np.array([int(s) for s in sums[1:]], dtype=object)
    moments = second_moments(fit_list, size, np.array([float(s / n) for s in total]))
    values, vectors = leading(moments / n, components)
    return Whitening(n, total, values, vectors, float(np.trace(moments / n)))


def _applied(white: Whitening, batches: Iterator[pa.RecordBatch]):
    """Each row's number of deviations and its whitened values."""
    exact, size = white.sums, len(white.sums)
    for batch in batches:
        x = _matrix(batch.column(batch.num_columns - 1), size)
        away = white.n * x.astype(np.float64) - exact.astype(np.float64)
        if (away**2).sum(axis=1).max(initial=0.0) >= 2.0**62:
            raise OverflowError("a deviation does not fit into 64 bits")
        deviation = ((white.n * x - exact.astype(np.int64)) ** 2).sum(axis=1)
        whitened = white.apply(x)
        flat = pa.array(whitened.ravel())
        ends = np.arange(len(x) + 1, dtype=np.int32) * whitened.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array(deviation),
                pa.ListArray.from_arrays(pa.array(ends), flat),
            ],
            names=[*batch.schema.names[:-1], "deviation", "whitened"],
        )


def whitened(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4
) -> DataFrame:
    """One row for each usable row and component: the key, ``component`` from 1, ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    spark = rows.sparkSession
    ready(spark)
    plain = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    used = integer_vectors(plain, "v")
    longest = used.agg(F.max(F.size("_x"))).first()[0] or 0
    used = used.where(F.size("_x") == longest).select("key", F.col("_x").alias("x"))
    fit_list = materialize(used.select("x").distinct(), "fit-list")
    white = fit(fit_list, components)
    schema = (
        f"{key} {rows.select(key).schema[0].dataType.simpleString()}, component int, n long,"
        " deviation long, whitened double, explained double, identity_error double"
    )
    if white is None or not len(white.values):
        return spark.createDataFrame([], schema)
    kind = used.schema["key"].dataType.simpleString()
    applied = used.mapInArrow(
        lambda b: _applied(white, b),
        f"key {kind}, deviation long, whitened array<double>",
    )
    # the covariance of the whitened fit list, centred by Spark's own aggregate
    made = fit_list.mapInArrow(
        lambda b: _applied(white, b), "deviation long, whitened array<double>"
    )
    count = len(white.values)
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    entries = made.agg(
        *[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs]
    ).first()
    error = max(abs(e - (i == j)) for e, (i, j) in zip(entries, pairs, strict=True))
    explained = F.array(*[F.lit(float(v / white.trace)) for v in white.values])
    return applied.select(
        "key", "deviation", F.posexplode("whitened").alias("at", "value")
    ).select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(white.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
