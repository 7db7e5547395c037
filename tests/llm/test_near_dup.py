"""Near duplicates against brute force over full shingle sets."""

import random
import re

import pytest

from quarterline.llm import graph, near_dup
from quarterline.llm.graph import components
from quarterline.session import BATCH_ROWS


def brute_force(rows, width=4):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = {}, {}
    for doc_id, text in rows:
        words = [w for w in re.split("[ \t-\r]+", (text or "").translate(lower)) if w]
        runs = {tuple(words[i: i + width]) for i in range(len(words) - width + 1)}
        own = runs if len(words) >= width else {tuple(words)} - {()}
        sets[doc_id], parent[doc_id] = own, doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def found(df):
    return {row["doc_id"]: (row["n_shingles"], row["component_id"], row["kept"]) for row in df.collect()}


def copies_of(base, count, edits, rng):
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(words)


def corpus(seed, groups, count, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(60, 160))]
        rows += copies_of(base, count, edits, rng)
    rng.shuffle(rows)
    return [(7 * i + 3, text) for i, text in enumerate(rows)]


@pytest.mark.parametrize("short", [2, 48])
def test_groups_of_copies_equal_brute_force(documents, monkeypatch, short):
    """``short`` 2 sends nearly every list through the differences from its head."""
    monkeypatch.setattr(near_dup, "SHORT", short)
    rows = corpus(1, 3, 60, 9)
    assert found(near_dup.near_duplicates(documents(rows))) == brute_force(rows)


@pytest.mark.parametrize("short", [1, 8])
def test_large_groups_that_resemble_each_other_cost_few_pairs(documents, monkeypatch, short):
    """Three groups of 70 whose bases share about 0.7 of their runs, so that they meet in many lists."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = list(copies_of(base, 70, 1, rng))
    for at in (5, 30):
        other = base[:at] + [f"y{at}{k}" for k in range(20)] + base[at + 20:]
        rows += copies_of(other, 70, 1, rng)
    rows = list(enumerate(rows))
    monkeypatch.setattr(near_dup, "SHORT", short)
    compared, given = [], near_dup._remaining_pairs

    def counted(*args):
        pairs = given(*args)
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dup, "_remaining_pairs", counted)
    got, expected = found(near_dup.near_duplicates(documents(rows))), brute_force(rows)
    assert got == expected and len({c for _, c, _ in expected.values()}) == 3
    assert compared[0] < (10 + short) * len(rows)


@pytest.mark.parametrize("width", [1, 5])
def test_other_widths(documents, width):
    rows = corpus(6, 2, 20, 6)
    assert found(near_dup.near_duplicates(documents(rows), width=width)) == brute_force(rows, width)


def test_edge_texts(documents):
    rows = [
        (5, None), (4, ""), (3, " \n\t "), (9, "one two three"), (8, "ONE  two\nthree"), (7, "one two"), (6, "Ärger one two three"),
        (2, "ärger one two three"), (11, "word " * 30000), (12, "WORD " * 20000), (1, "a b c d"), (10, "a b c d e"),
    ]
    assert found(near_dup.near_duplicates(documents(rows))) == brute_force(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame(
        [(1, text, "x", 0), (1, text, "y", 1), (2, text, None, 2), (None, text, "z", 3), (3, "other words are here", "z", 4)],
        "doc_id long, text string, kept string, component_id int")
    rows = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert rows == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_one_id_with_several_texts_links_their_groups(documents):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (9, b)]
    assert {r["component_id"] for r in near_dup.near_duplicates(documents(rows)).collect()} == {1}


def test_empty_table(documents):
    assert near_dup.near_duplicates(documents([])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_links_that_are_stars_already_need_no_round(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(graph, "stage", lambda df, keep=graph.stage: staged.append(1) or keep(df))
    stars = [(1, k) for k in range(2, 6)] + [(7, 8), (9, 9), (1, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), 7: 7, 8: 7} and len(staged) == 1
    # a child of two roots, and a child that is a root, are no stars
    for links in ([(1, 3), (2, 3)], [(1, 2), (2, 3)]):
        assert {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == {1: 1, 2: 1, 3: 1}


def test_python_workers_get_small_batches(spark, documents):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, wanted in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (7, 7)):
            spark.conf.set(key, str(given))
            near_dup.near_duplicates(documents([(1, "a b c d e")]))
            assert int(spark.conf.get(key)) == wanted
    finally:
        spark.conf.set(key, before)
