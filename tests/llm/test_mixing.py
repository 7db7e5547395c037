"""Exponents, rates and realised shares."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarterline.llm import mixing


def test_exponents():
    tokens = {"a": 1000, "b": 100, "c": 10}
    exponent, found = mixing.rates(tokens, max_repeat=2.0)
    assert found["a"] == pytest.approx(1) and found["c"] == pytest.approx(2) and 1 < found["b"] < 2
    assert 100 ** (1 - exponent) == pytest.approx(2)
    exponent, found = mixing.rates(tokens, target_entropy=0.9, max_repeat=None)
    shares = [tokens[k] * found[k] for k in tokens]
    assert -sum(s / sum(shares) * math.log(s / sum(shares)) for s in shares) == pytest.approx(0.9)
    # the limit wins over the target
    assert max(mixing.rates(tokens, target_entropy=1.09, max_repeat=3.0)[1].values()) == pytest.approx(3)
    assert mixing.rates({}) == (1.0, {}) and mixing.rates({None: 0, "x": 5})[1] == {None: 1.0, "x": 1.0}
    assert mixing.rates(tokens, max_repeat=None, budget=555)[1]["a"] == pytest.approx(0.5)


def test_realised_readings(documents):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(900)]
    rows += [(1000 + i, "w " * (1 + i % 5), "small") for i in range(90)] + [(2000 + i, None, None) for i in range(3)]
    df = documents(rows)
    plan = {r["source"]: r for r in mixing.plan(df).collect()}
    got = mixing.mixed(df).collect()
    tokens, seen = defaultdict(int), Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        seen[r["doc_id"]] += 1
        assert 0 <= r["position"] <= 1
    whole = defaultdict(int)
    for i, text, source in rows:
        whole[source] += len((text or "").split())
    for source in ("big", "small"):
        wanted = plan[source]["rate"] * whole[source]
        assert wanted <= tokens[source] + 1 and tokens[source] < wanted + 8
    assert set(seen) == {i for i, _, _ in rows}, "nothing is lost"
    assert max(seen.values()) <= 2


@pytest.mark.parametrize("targets", [{}, {"target_entropy": 1.2, "max_repeat": None}, {"max_repeat": 3.0, "budget": 9000.0}])
def test_readings_equal_brute_force(documents, targets):
    """Each reading of each row against permutations that are sorted and summed here."""
    rows = [(i, "w " * (1 + i % 7), ("a", "b", "b", "c", None, "a", "a")[i % 7] if i > 60 else "d") for i in range(900)]
    df = documents(rows + [(2000, "", "e"), (2001, None, "e")])
    exponent, found = mixing.rates(_totals(rows) | {"e": 0}, **targets)
    planned = {r["source"]: r for r in mixing.plan(df, **targets).collect()}
    epochs = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(max(found.values()))))).alias("e")
    numbered = df.select("doc_id", epochs).select("doc_id", "e", mixing._order(F.col("e")).alias("o"))
    order = {(r["e"], r["doc_id"]): r["o"] for r in numbered.collect()}
    want = Counter()
    for source, rate in found.items():
        assert planned[source]["rate"] == pytest.approx(rate) and planned[source]["exponent"] == pytest.approx(exponent)
        own = [(i, len((text or "").split())) for i, text, s in [*rows, (2000, "", "e"), (2001, None, "e")] if s == source]
        whole = math.floor(rate + 1e-9)
        left = round((rate - whole) * sum(n for _, n in own))
        want.update((i, e) for i, _ in own for e in range(whole))
        for i, n in sorted(own, key=lambda row: order[whole, row[0]]):
            if left > 0:
                want[i, whole] += 1
            left -= n
    assert Counter((r["doc_id"], r["epoch"]) for r in mixing.mixed(df, **targets).collect()) == want


def _totals(rows):
    totals = defaultdict(int)
    for _, text, source in rows:
        totals[source] += len((text or "").split())
    return dict(totals)


def test_many_sources_and_clashing_columns(spark, monkeypatch):
    df = spark.range(30000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "concat('s', id % 6000) AS source")
    want = sorted(map(tuple, mixing.mixed(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mixed(df).collect())) == want and len(want) >= 30000
    few = df.limit(50).selectExpr("*", "1 AS epoch", "2 AS position", "3 AS rate", "4 AS stop", "5 AS epochs")
    got = mixing.mix(few, mixing.plan(few))
    assert {"rate", "stop", "epochs", "epoch", "position"} <= set(got.columns) and got.filter("rate = 3 AND stop = 4").count() >= 50
    long = spark.createDataFrame([(1, "w " * 400000, "x"), (2, "w", "y")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mixed(long).collect()} == {1: 400000, 2: 1}


def test_partial_budget_reads_less(documents):
    df = documents([(i, "w w", "s") for i in range(400)])
    assert 195 <= mixing.mixed(df, max_repeat=None, budget=400).count() <= 205


def test_empty_and_repeated_rows(documents):
    assert mixing.mixed(documents([])).collect() == []
    assert mixing.mixed(documents([(1, "a", "s")] * 5)).count() == 5
