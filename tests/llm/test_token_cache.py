"""Token counts against the library on whole texts, and what the cache stores."""

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import token_cache as t
from quarterline.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b   ", "▁", " ▁ a▁b", "</s> <s> <unk> <0x41>", "line\nline\r\n\ttab", "ünï çödé ﬁ 漢字 テスト 🙂🙂",
    "x" * 5000, "word " * 9000, " no-break　wide", "1234567 3.14", "\x00nul\x00", "é" * 3000 + " end",
]


def test_counter_equals_the_library():
    counter = t.PieceCounter(PATH)
    assert counter.by_word
    assert counter.counts([x.encode() for x in TEXTS]) == [len(MODEL.encode(x)) for x in TEXTS]


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" ▁ \n<s>"), max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_counter_on_any_text(texts):
    assert t.piece_counter(PATH).counts([x.encode() for x in texts]) == [len(MODEL.encode(x)) for x in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(t, "WORDS", 3)
    counter = t.PieceCounter(PATH)
    assert counter.counts([x.encode() for x in TEXTS]) == [len(MODEL.encode(x)) for x in TEXTS]
    assert len(counter._known) < 60


def test_given_documents(spark, documents, small, tmp_path):
    got = {r["doc_id"]: r["n_tokens"] for r in t.count_tokens(documents(small), PATH, str(tmp_path)).collect()}
    assert got == {k: len(MODEL.encode(x or "")) for k, x in small}


def cached(spark, folder):
    return spark.read.parquet(str(folder)).collect()


ROWS = [(1, "one two"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (None, "three"), (5, "x" * 200_000), (6, "a▁b"), (7, "a b")]


def expected(rows, limit=t.LIMIT):
    return sorted(
        (k is not None, k or 0, len((x or "").encode()), n := len(MODEL.encode(x or "")), n > limit) for k, x in rows)


def counted(df, folder, **more):
    return sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in t.count_tokens(df, PATH, str(folder), **more).collect())


def test_rows_and_cache(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr(
        "*", "1 AS n_tokens", "'c' AS content", "2 AS content_digest", "3 AS copies")
    assert counted(df, tmp_path, limit=100) == expected(ROWS, 100)
    # one count per content: NULL and empty are one, so are the two spellings of a space
    assert len(cached(spark, tmp_path)) == 5


def test_only_missing_texts_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    first = spark.createDataFrame(ROWS, "doc_id long, text string")
    counted(first, tmp_path)
    version = t.tokenizer_digest(PATH)
    # counts that only the cache can have given
    t.stored_counts(spark, str(tmp_path), version).selectExpr("content_digest", "n_tokens + 1000 AS n_tokens").write.parquet(
        f"{tmp_path}/other/tokenizer={version}")
    more = [*ROWS, (8, "new text"), (9, "new text")]
    got = counted(spark.createDataFrame(more, "doc_id long, text string"), f"{tmp_path}/other")
    wanted = sorted((*r[:3], r[3] + (1000 if (r[1], r[0]) not in ((8, True), (9, True)) else 0), (r[3] + 1000 > t.LIMIT) if r[1] not in (8, 9) else r[4])
                    for r in expected(more))
    assert got == wanted
    assert len(cached(spark, f"{tmp_path}/other")) == 6
    # a large list of missing digests meets the texts in a shuffle
    monkeypatch.setattr(t, "BROADCAST_DIGESTS", 0)
    again = [*more, (10, "newer")]
    assert len(counted(spark.createDataFrame(again, "doc_id long, text string"), f"{tmp_path}/other")) == len(again)
    assert len(cached(spark, f"{tmp_path}/other")) == 7


def test_digests_appended_twice_count_once(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    counted(df, tmp_path)
    folder = f"{tmp_path}/tokenizer={t.tokenizer_digest(PATH)}"
    spark.read.parquet(folder).coalesce(1).write.mode("append").parquet(folder)
    assert counted(df, tmp_path) == expected(ROWS)


def test_another_tokenizer_has_other_counts(tmp_path):
    other = tmp_path / "other.model"
    other.write_bytes(open(PATH, "rb").read() + b"")
    assert t.tokenizer_digest(str(other)) == t.tokenizer_digest(PATH)
    other.write_bytes(open(PATH, "rb").read() + b"\0")
    assert t.tokenizer_digest(str(other)) != t.tokenizer_digest(PATH)


@pytest.mark.parametrize("times", [1, 2])
def test_empty_table(spark, documents, tmp_path, times):
    for _ in range(times):
        df = t.count_tokens(documents([]), PATH, str(tmp_path))
        assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and df.collect() == []
