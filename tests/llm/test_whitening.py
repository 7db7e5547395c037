"""Whitening against numpy's own eigenvectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import whitening as w
from quarterline.llm.eigen import leading_eigenpairs, sturm_counts, tridiagonal

SCHEMA = "vec_id long, embedding array<double>, n string, component string, spread int"


def table(spark, vectors, keys=None):
    keys = keys or range(len(vectors))
    return spark.createDataFrame([(k, x, "a", "b", 1) for k, x in zip(keys, vectors)], SCHEMA)


@given(st.integers(0, 10 ** 6), st.integers(1, 24), st.sampled_from(["random", "low rank", "equal values", "pairs", "steep", "diagonal"]))
@settings(max_examples=80, deadline=None)
def test_eigenpairs(seed, d, kind):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = {
        "random": rng.uniform(0, 5, d), "low rank": np.r_[rng.uniform(1, 2, 2), np.zeros(d)][:d], "equal values": np.full(d, 3.0),
        "pairs": np.repeat(rng.uniform(1, 9, d), 2)[:d], "steep": 10.0 ** -np.arange(d), "diagonal": np.arange(d) * 1.0,
    }[kind]
    matrix = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = leading_eigenpairs(matrix, 8)
    scale = max(np.abs(matrix).max(), 1e-300)
    assert np.abs(found - np.linalg.eigvalsh(matrix)[::-1][:8]).max() < 1e-12 * d * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-12 * d * scale


def test_counts_below_a_number():
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(30, 30))
    matrix = matrix + matrix.T
    diagonal, off, _ = tridiagonal(matrix)
    values = np.linalg.eigvalsh(matrix)
    at = np.linspace(values[0] - 1, values[-1] + 1, 50)
    assert (sturm_counts(diagonal, off, at) == (values[:, None] < at).sum(axis=0)).all()


@given(st.integers(0, 10 ** 6), st.integers(1, 60), st.integers(1, 6), st.sampled_from([0, 3, 10 ** 6, 2 ** 41]))
@settings(max_examples=40, deadline=None)
def test_products_are_exact(seed, rows, d, most):
    x = np.random.default_rng(seed).integers(-most, most + 1, (rows, d))
    whole = x.astype(object)
    assert (w.exact_products(x.astype(float)) == whole.T @ whole).all()


def expected(vectors, components=8):
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums).astype(float) / n
    matrix = centred.T @ centred / n
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return centred @ basis / np.sqrt(values), [int(v) for v in deviation], values / np.trace(matrix)


def test_whitened_equals_numpy(spark):
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)).tolist()
    bad = [None, [None] * 12, [float("nan")] * 12, [1.0] * 11 + [float("-inf")]]
    keys = [*range(398), None, 5]
    rows = w.whitened(table(spark, good + bad, keys + [90, 91, 92, 93])).collect()
    white, deviation, explained = expected(good)
    assert len(rows) == 400 * 8 and {r["n"] for r in rows} == {400}
    by_key = {}
    for r in rows:
        by_key.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    got = np.array([[by_key[k, d][c]["whitened"] for c in range(1, 9)] for k, d in zip(keys, deviation)])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-9
    first = by_key[0, deviation[0]]
    assert np.allclose([first[c]["explained"] for c in range(1, 9)], explained, rtol=1e-9)
    assert 0 <= rows[0]["identity_error"] < 1e-10


def test_model_does_not_depend_on_the_partitions(spark):
    df = table(spark, np.random.default_rng(6).normal(size=(300, 9)).tolist())
    one, many = w.fit(df.coalesce(1)), w.fit(df.repartition(9))
    assert one.sums == many.sums and (one.values == many.values).all() and (one.vectors == many.vectors).all()


@pytest.mark.parametrize("vectors, live", [([[0.5, 1.0]], 0), ([[0.5, 1.0]] * 4, 0), ([[0.0, 1.0], [0.0, 2.0], [0.0, 5.0]], 1)])
def test_directions_without_variance(spark, vectors, live):
    rows = w.whitened(table(spark, vectors)).collect()
    assert len(rows) == 2 * len(vectors)
    assert sum(r["whitened"] is not None for r in rows) == live * len(vectors)
    assert {r["identity_error"] is None for r in rows} == {live == 0}


def test_shorter_vectors_count_as_zero_there(spark):
    uneven = [[1.0, 2.0, 3.0], [4.0], [], [0.5, 0.25], [7.0, 1.0, 1.0]]
    full = [v + [0.0] * (3 - len(v)) for v in uneven]
    assert sorted(map(tuple, w.whitened(table(spark, uneven)).collect())) == sorted(map(tuple, w.whitened(table(spark, full)).collect()))


def test_huge_numbers_have_no_deviation(spark):
    rows = w.whitened(table(spark, [[3e8, 1.0], [-3e8, 2.0], [1e300, 0.0], [0.0, 0.0]])).collect()
    assert {r["deviation"] for r in rows} == {None} and all(r["spread"] > 2 ** 60 for r in rows)


@pytest.mark.parametrize("vectors", [[], [None], [[], []]])
def test_nothing_to_whiten(spark, vectors):
    df = w.whitened(table(spark, vectors))
    assert df.columns[:3] == ["vec_id", "component", "n"] and df.collect() == []
