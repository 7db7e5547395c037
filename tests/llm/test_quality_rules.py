"""The ledger against plain counting, policies and ablations against a loop over rows."""

import re
from collections import Counter

from quarterline.llm.quality_rules import MEASURES, POLICIES, RULES, ablations, apply_policy, ledger, policy_mask


def counted(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    runs = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i: i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(lines), sum(c.isalpha() for c in text), sum(c.isupper() for c in text))


TEXTS = [
    None, "", " \n \t", "a", "a b c", "a b c a b c", "a b c d a b c a b c", "x " * 4000, "one\ntwo\none\n\n two\none ",
    "éÉ ñandú 東京 #x# <b>", "a b\x0bc\x0cd\re a b c d", "THE CAPS!! ARE HERE " * 30, "w" * 30000,
    " ".join(f"w{i % 97} v{i % 89}" for i in range(9000)),
]


def test_measures_and_bits(documents):
    rows = {r["doc_id"]: r for r in ledger(documents(list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(rows[i][name] for name in MEASURES) == counted(text), text and text[:40]
    assert rows[1]["fail_bits"] == rows[0]["fail_bits"] == 1 and rows[7]["fail_bits"] & 2


def test_policies_and_ablations(documents, small):
    rows = ledger(documents(small + list(enumerate(TEXTS, 10 ** 6))))
    bits = [r["fail_bits"] for r in rows.collect()]
    for version, names in POLICIES.items():
        mask = policy_mask(version)
        kept = sum(r["kept"] for r in apply_policy(rows, version).collect())
        assert kept == sum(b & mask == 0 for b in bits)
        got = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in ablations(rows, version).collect()}
        for name in names:
            bit = 1 << RULES.index(name)
            assert got[name] == (
                sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_repeated_rows_clashing_columns_and_empty_table(spark, documents):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, None, 7)], "doc_id long, text string, words int")
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in ledger(df).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert ledger(documents([])).collect() == []


def test_no_python_and_no_shuffle(documents):
    plan = ledger(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
