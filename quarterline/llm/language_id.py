"""Language of texts by nearest centroid over character n-grams.

A text is the vector of its hashed character bigrams and trigrams, weighted by TF-IDF and
scaled to length 1. Each language has several centroids, found by clustering its training vectors,
since one language has several kinds of text. The prediction is the language of the centroid with the
largest cosine; one whose cosine is below what nearly all of the language's own training texts
reach is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: hash buckets of n-grams
DIMENSIONS = 1 << 13
#: centroids per language
CENTROIDS = 4
#: training texts per language, chosen by hash; languages with fewer give all
SAMPLE = 400
#: training texts in all; many languages share them
MOST_TEXTS = 8000
#: languages the training rows may have; more would not fit one model
MOST_LANGUAGES = 1000
#: share of a language's training texts that its distance threshold turns away
REJECT = 0.01
UNKNOWN = "und"
#: characters counted at once; one text alone may have more
_BATCH_CHARS = 1 << 19

_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    #: language number of each centroid
    owners: np.ndarray
    #: smallest cosine accepted, per language
    accepted: np.ndarray


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, one row per text: lower-cased, each run of non-letters one blank."""
    runs = [" " + text.lower() + " " for text in texts]
    joined = "".join(runs)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, inverse = np.unique(codes, return_inverse=True)
    letters = np.fromiter((0 if 0xD800 <= c < 0xE000 else chr(c).isalpha() for c in distinct), bool, len(distinct))[inverse]
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    owner = np.repeat(np.arange(len(runs)), sizes)
    plain = np.where(letters, codes, np.uint32(32))
    kept = np.ones(len(plain), bool)
    kept[1:] = (plain[1:] != 32) | (plain[:-1] != 32) | (owner[1:] != owner[:-1])
    plain, owner = plain[kept], owner[kept]
    result = np.zeros(len(runs) * DIMENSIONS, np.float32)
    for size, factor in ((2, np.uint32(0)), (3, _C)):
        if len(plain) < size:
            continue
        last = len(plain) - size + 1
        grams = plain[:last] * _A + plain[1: last + 1] * _B + plain[size - 1: last + size - 1] * factor + np.uint32(size)
        grams ^= grams >> np.uint32(15)
        whole = owner[:last] == owner[size - 1: last + size - 1]
        at = owner[:last][whole] * DIMENSIONS + (grams[whole] * np.uint32(2246822519) >> np.uint32(19))
        result += np.bincount(at, minlength=len(result)).astype(np.float32)
    return result.reshape(len(runs), DIMENSIONS)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _scaled(np.log1p(found) * idf)


def _cluster(vectors: np.ndarray, number: int) -> np.ndarray:
    """Centroids by spherical k-means; starts are the farthest from those chosen before."""
    chosen = [_scaled(vectors.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(number, len(vectors)):
        nearest = (vectors @ np.array(chosen).T).max(axis=1)
        chosen.append(vectors[nearest.argmin()])
    centroids = np.array(chosen)
    for _ in range(10):
        owner = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, vectors)
        filled = np.bincount(owner, minlength=len(centroids)) > 0
        centroids[filled] = _scaled(sums[filled])
    return centroids


def fit(training: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (key, text, lang): about ``sample`` texts of each language, chosen by a hash of ``key``.

    The rows per language are counted over all training rows. At most ``sample`` texts per
    language and ``MOST_TEXTS`` in all, give or take chance, reach the driver as counts of n-grams.
    """
    usable = training.filter("lang IS NOT NULL AND text RLIKE '[\\\\p{L}]'")
    sizes = {row["lang"]: row["count"] for row in usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    sample = max(1, min(sample, MOST_TEXTS // len(sizes)))
    span = 1 << 30
    limit = F.lit(0).cast("bigint")
    for lang, size in sorted(sizes.items()):
        limit = F.when(F.col("lang") == lang, F.lit(min(span, sample * span // size)).cast("bigint")).otherwise(limit)
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit("lid"), "key"), F.lit(span)) < limit).select("key", "text", "lang")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [counts([text]).astype(np.uint16 if len(text) < 60000 else np.uint32)[0] for text in part.column("text").to_pylist()]
            packed = [np.concatenate((np.flatnonzero(row), row[row > 0])).astype("<u4").tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("lang"), pa.array(packed, pa.binary())], names=["key", "lang", "packed"])

    rows = sorted(chosen.mapInArrow(run, "key string, lang string, packed binary").collect(), key=lambda r: (r["lang"], r["key"], bytes(r["packed"])))
    languages = sorted({row["lang"] for row in rows})
    labels = np.array([languages.index(row["lang"]) for row in rows])
    sparse = [np.frombuffer(row["packed"], "<u4").reshape(2, -1) for row in rows]
    frequency = np.bincount(np.concatenate([places for places, _ in sparse]), minlength=DIMENSIONS)
    idf = np.log((1 + len(rows)) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    centroids, owners, accepted = [], [], []
    for number in range(len(languages)):
        mine = np.flatnonzero(labels == number)
        found = np.zeros((len(mine), DIMENSIONS), np.float32)
        for vector, k in zip(found, mine):
            vector[sparse[k][0]] = sparse[k][1]
        own = _vectors(found, idf)
        clusters = _cluster(own, CENTROIDS)
        centroids.append(clusters)
        owners += [number] * len(clusters)
        accepted.append(np.quantile((own @ clusters.T).max(axis=1), REJECT))
    return Model(languages, idf, np.concatenate(centroids), np.array(owners), np.array(accepted))


def _judge(texts: list[str | None], model: Model) -> Iterator[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    run: list[str] = []
    marks: list[bool] = []
    size = 0

    def flush() -> Iterator[tuple[str, float, bool]]:
        cosines = _vectors(counts(run), model.idf) @ model.centroids.T if run else np.zeros((0, 1))
        best = cosines.argmax(axis=1) if run else []
        places = iter(range(len(run)))
        for known in marks:
            if not known:
                yield UNKNOWN, 0.0, True
                continue
            k = next(places)
            owner = model.owners[best[k]]
            score = float(np.clip(cosines[k, best[k]], 0, 1))
            yield model.languages[owner], score, bool(score < model.accepted[owner])

    for text in texts:
        known = bool(model.languages) and has_letter(text)
        marks.append(known)
        if known:
            run.append(text)
            size += len(text)
        if size >= _BATCH_CHARS or len(run) >= 64:
            yield from flush()
            run, marks, size = [], [], 0
    yield from flush()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score (cosine, 0 to 1) and rejected.

    One row per row. A text that is NULL or has no letter is ``und`` with score 0 and rejected, as is every text
    if the training rows had no language. Only the text decides, so equal texts agree; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = list(_judge(part.column("text").to_pylist(), shared.value))
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                pa.array(rejected, pa.bool_()),
            ], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, rejected boolean")
