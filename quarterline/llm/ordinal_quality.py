"""Graded quality of texts by an ordinal cumulative-link model.

Ratings are grades 0 to G. All grades share one weight per hashed feature; ordered thresholds cut the
score, P(grade > k) = logistic(score - threshold k). The model gives the expected grade and
the probability of the top grades, and selection goes by the latter. Features are the distinct words of
the whole text and what the text looks like: shares of capitals, signs, repeated words, long
words, each in steps. Only the text counts, so equal texts get equal grades.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.llm.samples import hash_sample
from quarterline.llm.words import batches, mix, word_hashes

#: rated rows the model is fitted on, chosen by a hash of their ids; all if there are fewer
RATED = 6000
#: hash bits of a feature
BITS = 17
#: rows a feature needs among the rated ones
LEAST = 4
#: weight of the penalty on the sum of absolute weights
PENALTY = 4e-4
#: share of the rated rows above which a word says nothing
COMMON = 0.2
ROUNDS, RATE = 300, 0.05
#: a text is selected if its probability of the top grade reaches this
SELECT = 0.5

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_ONLY_LETTERS = bytes(b if b in _LETTERS else 32 for b in range(256))
_CAPITALS = bytes(range(65, 91))
_SIGNS = b"#*$%&|<>!={}[]^~\\_@"
_STEPS = 10


@dataclass
class Model:
    weights: np.ndarray
    #: ascending; one less than there are grades
    thresholds: np.ndarray


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text; NULL is an empty text."""
    shift = np.uint64(64 - BITS)
    for _, raws in batches(texts):
        words, bounds = word_hashes([raw.translate(_ONLY_LETTERS) for raw in raws])
        for raw, begin, end in zip(raws, bounds[:-1], bounds[1:]):
            own = np.unique(words[begin:end])
            total, letters = int(end - begin), len(raw) - len(raw.translate(None, _LETTERS))
            shares = (
                (len(raw) - len(raw.translate(None, _CAPITALS)), letters),
                (3 * (len(raw) - len(raw.translate(None, _SIGNS))), len(raw)),
                (total - len(own), total),
                (letters, 16 * total),
                (total.bit_length(), 32),
            )
            looks = [
                (k + 1) * 100 + (min(_STEPS, _STEPS * part // whole) if whole else 50)
                for k, (part, whole) in enumerate(shares)
            ]
            yield np.unique(np.concatenate((own, mix(np.array(looks, np.uint64)))) >> shift).astype(np.int64)


def _is_look() -> np.ndarray:
    """Which feature numbers stand for looks."""
    numbers = np.array([100 * (k + 1) + step for k in range(5) for step in range(51)], np.uint64)
    result = np.zeros(1 << BITS, bool)
    result[(mix(numbers) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return result


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, top: int) -> Model:
    """Adaptive proximal gradient steps on the mean log-likelihood with an absolute penalty.

    Words that are rare among ``rows``, or in too many of them, get no weight. Thresholds are kept in order.
    """
    n, each = len(rows), np.arange(len(rows))
    at = np.repeat(each, [len(row) for row in rows])
    column = np.concatenate(rows)
    seen = np.bincount(column, minlength=1 << BITS)
    used = (seen >= LEAST) & ((seen <= COMMON * n) | _is_look())
    at, column = at[used[column]], column[used[column]]
    chosen = np.flatnonzero(used)
    column = np.searchsorted(chosen, column)
    weights = np.zeros(len(chosen))
    share = [np.clip(np.mean(grades > k), 1e-3, 1 - 1e-3) for k in range(top)]
    thresholds = np.maximum.accumulate([-np.log(p / (1 - p)) for p in share]) + 1e-3 * np.arange(top)
    mean, square = np.zeros(len(chosen)), np.zeros(len(chosen))
    cut_mean, cut_square = np.zeros(top), np.zeros(top)
    inner, outer = grades > 0, grades < top
    for step in range(1, ROUNDS + 1):
        score = np.bincount(at, weights[column], minlength=n)
        tail = np.hstack((np.ones((n, 1)), _logistic(score[:, None] - thresholds), np.zeros((n, 1))))
        chance = n * np.maximum(tail[each, grades] - tail[each, grades + 1], 1e-9)
        slope = tail * (1 - tail)
        upper, lower = slope[each, grades] / chance, slope[each, grades + 1] / chance
        gradient = -np.bincount(column, (upper - lower)[at], minlength=len(chosen))
        cut = np.bincount(grades[inner] - 1, upper[inner], minlength=top) - np.bincount(
            grades[outer], lower[outer], minlength=top)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        cut_mean, cut_square = 0.9 * cut_mean + 0.1 * cut, 0.99 * cut_square + 0.01 * cut ** 2
        fresh, fresh_square = 1 - 0.9 ** step, 1 - 0.99 ** step
        rate = RATE * min(1, 2 * (ROUNDS - step) / ROUNDS + 0.02) / (np.sqrt(square / fresh_square) + 1e-5)
        weights -= rate * mean / fresh
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * PENALTY, 0)
        thresholds -= RATE * cut_mean / fresh / (np.sqrt(cut_square / fresh_square) + 1e-6)
        thresholds = np.maximum.accumulate(thresholds) + 1e-6 * np.arange(top)
    whole = np.zeros(1 << BITS)
    whole[chosen] = weights
    return Model(whole, thresholds)


def fit(docs: DataFrame, ratings: DataFrame, rated: int = RATED) -> Model | None:
    """Learn from ``ratings`` (doc_id, grade from 0) of ``docs`` (doc_id, text); None without any.

    About ``rated`` ratings are chosen by a hash of doc_id before texts are looked up, and their
    features reach the driver. NULL ids and grades teach nothing.
    """
    chosen = hash_sample(ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", "grade"), "doc_id", rated)

    def run(parts):
        for part in parts:
            found = [row.astype("<i4").tobytes() for row in features(part["text"].tolist())]
            yield pd.DataFrame({"doc_id": part["doc_id"], "grade": part["grade"], "features": found})

    # at most about ``rated`` rows of 12 bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(
        run, "doc_id long, grade int, features binary").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda row: (row["doc_id"], row["grade"], bytes(row["features"])))
    grades = np.array([row["grade"] for row in rows])
    top = max(1, int(grades.max()))
    return fit_rows([np.frombuffer(row["features"], "<i4").astype(np.int64) for row in rows], grades, top)


def grade(text: Column, docs: DataFrame, model: Model | None) -> Column:
    """struct(expected_grade, tail_probability) of a text column; NULL texts are graded as empty ones.

    Without a model every text is selected: no expected grade, probability 1.
    """
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail_probability"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def run(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        scores = np.fromiter((known.weights[row].sum() for row in features(texts.tolist())), float, len(texts))
        tails = _logistic(scores[:, None] - known.thresholds)
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, -1]})

    return run(text)


def graded(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs``: doc_id, expected_grade, tail_probability, kept (probability >= ``SELECT``).

    Repeated rows give repeated results, other columns are dropped, an empty table gives an empty one.
    """
    rows = docs.select("doc_id", grade(F.col("text"), docs, model).alias("g"))
    return rows.select("doc_id", "g.expected_grade", "g.tail_probability", (F.col("g.tail_probability") >= SELECT).alias("kept"))


def select(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with exactly their columns."""
    name = "_grade"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, grade(F.col("text"), docs, model))
    return rows.filter(F.col(name)["tail_probability"] >= SELECT).drop(name)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of quality and toxicity labels: 0 toxic, 1 poor, 2 good."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return labels.filter("quality IS NOT NULL").select(
        "doc_id", F.when(toxic, 0).otherwise(F.when(F.col("quality") == 0, 1).otherwise(2)).cast("int").alias("grade"))
