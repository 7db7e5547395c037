"""Product codes against brute force: the walk on two trees, and the whole operator."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import vector_codes as v


def nearest(points, books):
    return ((points[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3).argmin(axis=2)


def walked(points, books):
    order = v.tree_order(points, v.LEAF)
    parts = v.Tree.over(np.take_along_axis(points, order[:, :, None], axis=1), v.LEAF)
    return parts, v.assign(parts, v.EntryTree.over(books))


@given(st.integers(0, 10 ** 6), st.integers(1, 400), st.integers(1, 70), st.integers(1, 5), st.sampled_from([0, 1, 3, 40, 2 ** 25]))
@settings(max_examples=60, deadline=None)
def test_walk_equals_all_distances(seed, n, entries, width, spread):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (3, n, width))
    books = rng.integers(-spread, spread + 1, (3, entries, width))
    parts, found = walked(points, books)
    expected = nearest(parts.points, books)
    assert (v.point_entries(parts, found) == expected).all()
    counts, sums = v.entry_totals(parts, found, entries)
    for tree in range(3):
        for entry in range(entries):
            own = parts.points[tree][expected[tree] == entry]
            assert counts[tree, entry] == len(own) and (sums[tree, entry] == own.sum(axis=0)).all()


def test_walk_knows_more_entries_than_the_query():
    rng = np.random.default_rng(0)
    points, books = rng.integers(-3, 4, (3, 40, 3)), rng.integers(-3, 4, (3, 3 * v.ENTRIES, 3))
    parts, found = walked(points, books)
    assert (v.point_entries(parts, found) == nearest(parts.points, books)).all()


def test_whole_nodes_are_assigned_at_once():
    rng = np.random.default_rng(5)
    books = rng.integers(-500, 500, (1, 16, 2))
    points = books[:, rng.integers(0, 16, 4000)] + rng.integers(-5, 6, (1, 4000, 2))
    _, found = walked(points, books)
    assert (found.node_end - found.node_start).sum() > 3500


def brute(rows, entries=64):
    """{row number: (code, error)} and the codebooks' digest of [(key, label, vector)]."""
    good = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    width = max(1, -(-max(len(r[2]) for r in good) // 16))
    whole = [[int(np.floor(256 * x)) for x in r[2]] + [0] * (16 * width - len(r[2])) for r in good]
    x = np.array(whole).reshape(len(good), 16, width).transpose(1, 0, 2)
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, whole[i]))[:entries]
    books = x[:, first].copy()
    for _ in range(2):
        codes = nearest(x, books)
        for p in range(16):
            for e in range(len(first)):
                if (codes[p] == e).any():
                    books[p, e] = x[p][codes[p] == e].sum(axis=0) // (codes[p] == e).sum()
    codes = nearest(x, books)
    errors = ((x - np.take_along_axis(books, codes[:, :, None], axis=1)) ** 2).sum(axis=(0, 2))
    by_label = {}
    for r, error in zip(good, errors):
        by_label[r[1]] = by_label.get(r[1], 0) + int(error)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted(
        (r[0] is not None, r[0] or 0, "".join("%02x" % c for c in codes[:, i]), int(errors[i]), by_label[r[1]], digest)
        for i, r in enumerate(good))


SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string, _label int, n int"


def compressed(df):
    return sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in v.compress(df).collect())


def table(spark, rows):
    return spark.createDataFrame([(a, c, b, 1, "x", 2, 3) for a, b, c in rows], SCHEMA)


def vectors(count, size, seed=3):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in rng.normal(size=size)] for _ in range(count)]


def test_compress_equals_brute_force(spark, monkeypatch):
    rows = [(k, k % 5 if k % 7 else None, x) for k, x in enumerate(vectors(300, 32))]
    rows += [rows[3], rows[3], (None, 1, rows[4][2]), (7, 2, rows[5][2])]
    rows += [(900, 1, None), (901, 1, [None] * 32), (902, 1, [float("nan")] * 32), (903, 1, [float("inf")] * 32), (904, 1, [1e5] * 31)]
    assert compressed(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("rows", [
    [(1, 1, [0.5] * 16)], [(k, None, [0.25] * 20) for k in range(9)], [(1, 1, []), (2, 1, [])],
    [(k, k, x[: 3 + k]) for k, x in enumerate(vectors(20, 40))],
])
def test_few_equal_and_uneven_vectors(spark, rows):
    assert compressed(table(spark, rows)) == brute(rows)


def test_empty_table(spark):
    df = v.compress(table(spark, []))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.collect() == []


def test_blocks_do_not_matter(spark):
    df = table(spark, [(k, 1, x) for k, x in enumerate(vectors(500, 16))])
    assert compressed(df.repartition(7)) == compressed(df.coalesce(1))
