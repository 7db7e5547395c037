"""Leading eigenpairs of one symmetric matrix, whose size is that of a vector and not of a table."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: eigenvalues nearer to each other than this share of the norm form a cluster
CLUSTER = 1e-3
#: solves per eigenvector; two suffice where the start is not orthogonal to it
SOLVES = 4


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of Householder's reduction.

    Reflector ``k`` is a unit vector over the coordinates from ``k + 1`` on, or empty where nothing had to be reflected.
    """
    a = np.array(matrix, float)
    d = len(a)
    off = np.zeros(max(d - 1, 0))
    reflectors = []
    for k in range(d - 1):
        column = a[k + 1:, k].copy()
        rest = np.linalg.norm(column[1:])
        if rest == 0:
            off[k] = column[0]
            reflectors.append(np.zeros(0))
            continue
        off[k] = -np.copysign(np.hypot(column[0], rest), column[0])
        column[0] -= off[k]
        v = column / np.linalg.norm(column)
        block = a[k + 1:, k + 1:]
        image = block @ v
        w = 2 * (image - (v @ image) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        reflectors.append(v)
    return np.diag(a).copy(), off, reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number of ``at``."""
    tiny = np.finfo(float).tiny
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(int)
    for value, beside in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        with np.errstate(over="ignore"):
            pivot = value - at - beside * beside / pivot
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest, falling, by bisection until no double lies between the bounds."""
    d = len(diagonal)
    radius = np.concatenate((np.abs(off), [0])) + np.concatenate(([0], np.abs(off)))
    slack = 4 * EPS * max(np.abs(diagonal).max() + radius.max(), np.finfo(float).tiny)
    low = np.full(count, (diagonal - radius).min() - slack)
    high = np.full(count, (diagonal + radius).max() + slack)
    ranks = d - 1 - np.arange(count)
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        above = sturm_counts(diagonal, off, middle) <= ranks
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) z = right by elimination with row exchanges; pivots are at least ``least``."""
    d = len(diagonal)
    first, second, third = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    z = right.copy()
    for k in range(d - 1):
        below, next_first, next_second = off[k], first[k + 1], second[k + 1]
        if abs(below) > abs(first[k]):
            factor = first[k] / below
            first[k], second[k], third[k], first[k + 1], second[k + 1] = (
                below, next_first, next_second, second[k] - factor * next_first, -factor * next_second)
            z[k], z[k + 1] = z[k + 1], z[k] - factor * z[k + 1]
        else:
            if abs(first[k]) < least:
                first[k] = least
            factor = below / first[k]
            first[k + 1] = next_first - factor * second[k]
            z[k + 1] -= factor * z[k]
    if abs(first[-1]) < least:
        first[-1] = least
    for k in range(d - 1, -1, -1):
        later = (second[k] * z[k + 1] if k + 1 < d else 0.0) + (third[k] * z[k + 2] if k + 2 < d else 0.0)
        z[k] = (z[k] - later) / first[k]
    return z


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) for falling ``values`` by inverse iteration.

    In a run of values that lie close together, each vector is made orthogonal to the run's earlier ones after every solve.
    """
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    least = EPS * norm
    starts = np.random.default_rng(11).uniform(0.5, 1.0, (len(values), d))
    found = np.zeros((len(values), d))
    run, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            run = k
        # equal values would give one vector again and again: keep the shifts a few steps apart
        shift = min(value, shift - 4 * least) if k > run else value
        z = starts[k]
        for _ in range(SOLVES):
            z = _solve(diagonal, off, shift, z / np.abs(z).max(), least)
            z /= np.abs(z).max()
            for _ in range(2):
                z = z - found[run:k].T @ (found[run:k] @ z)
            z /= np.linalg.norm(z)
        found[k] = z
    return found


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as rows.

    The entry of a vector that is largest in size is positive.
    """
    d = len(matrix)
    count = min(count, d)
    if not count:
        return np.zeros(0), np.zeros((0, d))
    scale = np.abs(matrix).max()
    if scale == 0:
        return np.zeros(count), np.eye(count, d)
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, count)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if len(v):
            vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    largest = np.abs(vectors).argmax(axis=1)
    return values * scale, vectors * np.sign(vectors[np.arange(count), largest])[:, None]
