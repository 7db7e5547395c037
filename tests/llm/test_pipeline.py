"""The five stages on the smallest data: each does its work and loses nothing else."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from quarterline.session import stage
from tests.llm.test_near_dup import brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, function in pipeline.STAGES:
        docs.append(stage(function(spark, docs[-1], SF)))
    return docs


def test_columns_and_names(steps):
    assert [len(pipeline.STAGES), pipeline.ORACLE_SQL] == [5, None]
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_decisions(steps):
    given, good, single, clean, mixed, packed = ([tuple(r) for r in df.collect()] for df in steps)
    assert set(good) <= set(given) and len(good) > 0.6 * len(given)
    kept = {i for i, (_, _, kept) in brute_force([r[:2] for r in good], pipeline.WIDTH).items() if kept}
    assert {r[0] for r in single} == kept and len(single) == len(kept)
    assert {r[0] for r in clean} == kept
    before = {r[0]: r[1] for r in single}
    changed = {r[0] for r in clean if r[1] != before[r[0]]}
    assert changed == {i for i, text in before.items() if re.search(r'token = "[0-9a-f]{40}"', text)}
    assert not any(re.search("[0-9a-f]{24}", r[1]) for r in clean)
    readings = Counter(mixed)
    assert set(readings) == set(clean) and max(readings.values()) <= 2
    pieces = Counter((r[0], r[1]) for r in packed)
    assert all(pieces[r[0], 0] == readings[r] for r in readings)


def test_run_is_the_stages_in_order(spark, steps):
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    again = pipeline.run(spark, SF).select(columns).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, steps[-1].select(columns).collect()))


def test_empty_input(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, function in pipeline.STAGES:
        out = function(spark, empty, SF)
        assert out.collect() == []


def test_documents_without_an_id_stay(spark, documents):
    texts = ["one of the texts without an id", "quite another text that has no id either", "", "a third of them"]
    rows = [(None, text) for text in texts + texts[:1]] + [(1, "text with an id of its own"), (1, "text with an id of its own"), (2, "more")]
    got = [tuple(r)[:2] for r in pipeline.near_dedup(spark, documents(rows), SF).collect()]
    assert sorted(got, key=str) == sorted([(None, text) for text in texts] + [(1, "text with an id of its own"), (2, "more")], key=str)


def test_different_texts_under_one_id_stay(spark, documents):
    one, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    near = one.replace("a30", "changed")
    rows = [(1, one), (1, other), (1, one), (2, near), (None, one), (None, "no id, no twin, five words"), (3, "x" * 300_000), (4, None)]
    got = sorted(((r[0] or 0), r[1]) for r in pipeline.near_dedup(spark, documents(rows), SF).collect() if r[1])
    texts = [t for _, t in got]
    assert sorted(texts) == sorted([t for t in texts if t in (one, near)] + [other, "no id, no twin, five words", "x" * 300_000])
    assert sum(t in (one, near) for t in texts) == 1 and got[-1][0] == 3


def test_extra_columns_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr(
        "*", "doc_id * 3 AS epoch", "concat('p', doc_id) AS position", "doc_id + 1 AS spans", "-doc_id AS _kept", "doc_id * 2 AS _rate")
    given = {tuple(r)[5:] for r in docs.collect()}
    for name, function in pipeline.STAGES[:4]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        found = {tuple(r)[5:] for r in out.collect()}
        assert found and found <= given, name
