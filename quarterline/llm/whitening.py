"""Whitening of embeddings: covariance on the executors, eigenvectors of the small matrix, projection of every row.

Entries become whole numbers first, so that sums and products are exact whatever the
partitioning: a lost task that runs again changes no digit. A task adds up its part of the table and sends
one number per pair of dimensions; Spark adds those. What reaches the driver is one matrix of
dimension x dimension, which does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.llm.eigen import EPS, leading_eigenpairs
from quarterline.llm.vectors import finite_vectors, scaled_floor

COMPONENTS = 8
SCALE = 1024.0
#: added to every whole number, as the contract of the query states them; no result depends on it
OFFSET = 100_000
#: whole numbers beyond this count as this
MOST = 2.0 ** 40
#: doubles hold whole numbers exactly up to here
_EXACT = 2 ** 53
_TOTALS = "at int, total decimal(38,0)"


def _totals(at: np.ndarray, totals: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array([Decimal(int(x)) for x in totals], pa.decimal128(38, 0))], names=["at", "total"])


def _added(partial: DataFrame) -> dict[int, int]:
    return {row["at"]: int(row["total"]) for row in partial.groupBy("at").agg(F.sum("total").alias("total")).collect()}


def _column_sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each dimension, and under -1 the number of vectors."""
    count, sums = 0, np.zeros(0, object)
    for part in parts:
        x = scaled_floor(part.column(0), SCALE, MOST)
        count += len(x)
        if x.shape[1] > len(sums):
            sums = np.concatenate((sums, np.zeros(x.shape[1] - len(sums), object)))
        sums[: x.shape[1]] += x.astype(np.int64).sum(axis=0)
    yield _totals(np.arange(-1, len(sums)), [count, *sums])


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, as Python integers where doubles could round."""
    largest = float(np.abs(x).max(initial=0.0))
    rows = len(x) if largest == 0 else int(min(len(x), _EXACT // int(largest) ** 2))
    if rows == 0:
        whole = x.astype(np.int64).astype(object)
        return whole.T @ whole
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), rows):
        total += (x[at: at + rows].T @ x[at: at + rows]).astype(np.int64)
    return total


def _product_sums(centre: np.ndarray):
    upper = np.triu_indices(len(centre))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)), object)
        for part in parts:
            total += exact_products(scaled_floor(part.column(0), SCALE, MOST, len(centre)) - centre)
        yield _totals(np.arange(len(upper[0])), total[upper])

    return run


@dataclass(frozen=True)
class Whitener:
    """What a projection needs: a few numbers per dimension and component."""

    n: int
    sums: tuple[int, ...]           # of the whole numbers, without the offset
    centre: np.ndarray              # whole numbers next to the mean
    rest: np.ndarray                # mean - centre
    values: np.ndarray              # eigenvalues, falling
    vectors: np.ndarray             # unit eigenvectors as rows
    explained: np.ndarray           # eigenvalue / trace; NaN if nothing varies
    live: np.ndarray                # components along which vectors differ

    def centred(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(whole numbers less the centre, whole numbers less the mean)."""
        y = scaled_floor(column, SCALE, MOST, len(self.centre)) - self.centre
        return y, y - self.rest

    def project(self, centred: np.ndarray) -> np.ndarray:
        scores = centred @ self.vectors.T
        return np.divide(scores, np.sqrt(np.where(self.live, self.values, 1.0)))


def covariance(x: DataFrame, vector: str, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers next to the mean, covariance with divisor n), each entry rounded once.

    With y the numbers less the centre, n * n * covariance = n * sum(y y') - r r' in whole numbers, r = sum(y).
    """
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _added(x.select(vector).mapInArrow(_product_sums(np.array(centre, float)), _TOTALS))
    left = [s - n * c for s, c in zip(sums, centre)]
    matrix = np.zeros((d, d))
    for at, (i, j) in enumerate(zip(*np.triu_indices(d))):
        matrix[i, j] = matrix[j, i] = (n * products[at] - left[i] * left[j]) / (n * n)
    return np.array(centre, float), matrix


def _few_tasks(df: DataFrame) -> DataFrame:
    """Tasks that read several splits each: every task sends a number per pair of dimensions, however few its rows."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def fit(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitener:
    """Mean, covariance and leading components of all vectors of ``df`` (see ``whiten``)."""
    x = _few_tasks(finite_vectors(df, vector=vector))
    found = _added(x.mapInArrow(_column_sums, _TOTALS))
    n = found.pop(-1, 0)
    sums = tuple(found[i] for i in range(len(found)))
    if not n or not sums:
        nothing = np.zeros(0)
        return Whitener(n, sums, nothing, nothing, nothing, np.zeros((0, len(sums))), nothing, np.zeros(0, bool))
    centre, matrix = covariance(x, vector, n, sums)
    values, vectors = leading_eigenpairs(matrix, components)
    trace = float(np.trace(matrix))
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre)])
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitener(n, sums, centre, rest, values, vectors, explained, values > len(sums) * EPS * trace)


def identity_error(df: DataFrame, fitted: Whitener, vector: str = "embedding") -> float | None:
    """Largest entry of (covariance of the whitened rows - identity), measured on all rows; None if nothing varies."""
    k = int(fitted.live.sum())
    if not k:
        return None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for part in parts:
            white = fitted.project(fitted.centred(part.column(0))[1])[:, fitted.live]
            sums += white.sum(axis=0)
            products += white.T @ white
        values = np.concatenate((sums, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "total"])

    partial = _few_tasks(finite_vectors(df, vector=vector)).mapInArrow(run, "at int, total double")
    rows = {row["at"]: row["total"] for row in partial.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    values = np.array([rows[i] for i in range(k + k * k)]) / fitted.n
    # rows were centred before; what is left of the mean is rounding
    return float(np.abs(values[k:].reshape(k, k) - np.outer(values[:k], values[:k]) - np.eye(k)).max())


def deviations(y: np.ndarray, fitted: Whitener) -> tuple[list[int | None], np.ndarray]:
    """Per row the exact sum over dimensions of (n * x - sum)^2, None beyond a 64-bit number, and that over n * n.

    Where all terms are sure to fit, arithmetic is on 64-bit numbers; otherwise it is on Python's.
    """
    n, left = fitted.n, [s - fitted.n * int(c) for s, c in zip(fitted.sums, fitted.centre)]
    apart = ((y - fitted.rest) ** 2).sum(axis=1)
    largest = n * int(np.abs(y).max(initial=0.0)) + n
    if y.shape[1] * largest * largest < 2 ** 63:
        each = n * y.astype(np.int64) - np.array(left, np.int64)
        return (each * each).sum(axis=1).tolist(), apart
    exact: list[int | None] = [None] * len(y)
    for k in np.flatnonzero(apart * float(n) * float(n) < 2.0 ** 63 * (1 + 1e-6)):
        value = sum((n * int(a) - b) ** 2 for a, b in zip(y[k], left))
        exact[k] = value if value < 2 ** 63 else None
    return exact, apart


def whiten(df: DataFrame, fitted: Whitener, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: the key, component, n, deviation, whitened, explained, spread.

    Every entry c counts as x = floor(1024 * c) + 100000; numbers beyond 2^40 count as 2^40. Rows whose vector is
    NULL or holds a NULL, NaN or infinite entry are dropped; a vector shorter than the longest is filled up
    with zeros. A NULL key stays NULL, and repeated rows get rows of their own. Other columns are ignored.

    ``deviation`` is the sum of (n * x - S)^2 over the dimensions, exact, NULL where it is no 64-bit number;
    ``spread`` is that divided by n * n. ``whitened`` is NULL along a component in which the vectors do not
    differ (few vectors, equal vectors), and ``explained`` if they are all equal. An empty table, and one
    of empty vectors, give an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    explained = [None if np.isnan(x) else float(x) for x in fitted.explained]
    k = len(fitted.values)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts if k else ():
            y, centred = fitted.centred(part.column(1))
            white = fitted.project(centred)
            exact, apart = deviations(y, fitted)
            rows = len(y)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, fitted.n), pa.int64()),
                pa.array(exact, pa.int64()).take(pa.array(each)),
                pa.array(white.ravel(), mask=~np.tile(fitted.live, rows)),
                pa.array(explained * rows, pa.float64()),
                pa.array(apart[each]),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "spread"])

    return finite_vectors(df, key, vector=vector).mapInArrow(
        run, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, spread double")


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fit on all vectors and project them, with ``identity_error`` on every row; see ``whiten``."""
    fitted = fit(df, components)
    error = F.lit(identity_error(df, fitted)).cast("double")
    return whiten(df, fitted).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", error.alias("identity_error"), "spread")
