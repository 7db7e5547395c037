"""Language identification and ordinal quality: held-out accuracy, exact scores, edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterline.llm import language_id, ordinal_quality
from quarterline.llm.words import batches, shingle_sets, word_hashes

SYLLABLES = {"aa": "ka lo mi ne su ta", "bb": "sch ung keit vor ein ze", "cc": "ción ado mente ños que las"}


def prose(lang, rng, words=80):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(words))


def test_held_out_languages(spark):
    rng = random.Random(2)
    rows = [(str(i), prose(lang, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    df = spark.createDataFrame(rows, "key string, text string, lang string")
    model = language_id.fit(df.filter("cast(key as int) % 3 <> 0 or cast(key as int) < 90"), sample=30)
    docs = [(i, prose(lang, rng, 1 + i % 40), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    got = {r["doc_id"]: r for r in language_id.identify(
        spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in docs]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_scores_equal_one_text_at_a_time(documents, small):
    df = documents(small).withColumn("key", F.col("doc_id").cast("string"))
    model = language_id.fit(df.select("key", "text", "lang"))
    for row in language_id.identify(df, model).collect()[:60]:
        text = dict(small)[row["doc_id"]]
        vector = np.log1p(language_id.counts([text])[0]) * model.idf
        cosine = max(model.centroids @ (vector / np.linalg.norm(vector)))
        assert row["score"] == pytest.approx(float(np.clip(cosine, 0, 1)), abs=1e-5)


def test_texts_without_letters_and_without_training(spark, documents):
    rows = [(1, None), (2, ""), (3, "12 !! \n"), (4, "abc"), (4, "abc"), (None, "x" * 200000)]
    df = documents(rows)
    none = language_id.fit(df.filter("false").selectExpr("text AS key", "text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    some = language_id.fit(df.selectExpr("'k' AS key", "text", "lang"))
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(df, some).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en")], key=str)
    assert language_id.identify(documents([]), some).collect() == []


def graded_rows(rng, count):
    rows, grades = [], []
    for i in range(count):
        words = [f"w{rng.randrange(400)}x" for _ in range(rng.randint(20, 80))]
        grade = rng.choice([0, 1, 2, 2])
        if grade == 0:
            words += rng.sample(["vile", "nasty", "foul", "mean", "rude", "dumb", "crass", "lousy"], 3)
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    return rows, grades


def test_grades_are_learned_in_order(spark, documents):
    rng = random.Random(4)
    rows, grades = graded_rows(rng, 600)
    model = ordinal_quality.fit(documents(rows), spark.createDataFrame(grades[:400], "doc_id long, grade int"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in ordinal_quality.graded(documents(rows), model).collect()}
    for i, grade in grades[400:]:
        row = got[i]
        score = model.weights[next(ordinal_quality.features([rows[i][1]]))].sum()
        tails = 1 / (1 + np.exp(model.thresholds - score))
        assert row["expected_grade"] == pytest.approx(tails.sum()) and row["tail_probability"] == pytest.approx(tails[-1])
    assert np.mean([got[i]["kept"] == (grade == 2) for i, grade in grades[400:]]) > 0.95


def test_selection_keeps_columns_and_edge_rows(spark, documents):
    rng = random.Random(6)
    rows, grades = graded_rows(rng, 200)
    model = ordinal_quality.fit(documents(rows), spark.createDataFrame([*grades, (None, 1), (5, None)], "doc_id long, grade int"))
    odd = spark.createDataFrame(
        [(1, None, 7), (2, "", 7), (3, "w1x " * 60000, 7), (3, "vile nasty foul vile", 7)], "doc_id long, text string, _grade int")
    assert ordinal_quality.select(odd, model).columns == odd.columns
    assert ordinal_quality.graded(odd, model).count() == 4
    assert ordinal_quality.fit(documents([]), spark.createDataFrame([], "doc_id long, grade int")) is None
    assert ordinal_quality.select(odd, None).count() == 4
    assert ordinal_quality.graded(documents([]), model).collect() == []


def test_word_and_shingle_hashes():
    texts = ["A b\tc\n d", "a B c d e", "", None, "é ö é ö é", "x", "A b c D e"]
    (first, raws), = batches(texts)
    words, bounds = word_hashes(raws)
    assert list(np.diff(bounds)) == [4, 5, 0, 0, 5, 1, 5]
    assert list(words[:4]) == list(words[4:8]) and len(set(words[:9].tolist())) == 5
    sets = list(shingle_sets(raws, 4))
    assert [len(s) for s in sets] == [1, 2, 0, 0, 2, 1, 2] and set(sets[0]) < set(sets[1]) == set(sets[6])
