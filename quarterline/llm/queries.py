"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.llm.fingerprints import fingerprints
from quarterline.llm.language_id import fit as fit_languages
from quarterline.llm.language_id import identify
from quarterline.llm.mixing import mixed
from quarterline.llm.near_dup import near_duplicates
from quarterline.llm.ordinal_quality import fit as fit_grades
from quarterline.llm.ordinal_quality import graded, grades_of
from quarterline.llm.packing import pack_documents
from quarterline.llm.perspectives import views
from quarterline.llm.quality_rules import apply_policy, ledger, policy_mask
from quarterline.llm.secret_scan import corpus_samples, find_secrets, listed, train
from quarterline.llm.token_cache import count_tokens
from quarterline.llm.vector_codes import compress
from quarterline.llm.whitening import whitened
from quarterline.llm.wrappers import host_wrappers, main_texts
from quarterline.session import stage, staging_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; imported late, only packing and counting need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op3_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(_table(spark, sf_dir, "documents")), "v1")
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base")).cast("bigint")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "fail_bits")


ORACLE["op3_rule_bitmask_ledger"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split),
windows AS (
  SELECT doc_id, pos, [word, lead(word) OVER w, lead(word, 2) OVER w] AS run
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (
  SELECT doc_id, pos FROM windows WHERE run[3] IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
m AS (
  SELECT s.doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_sum,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_capitals
  FROM split s LEFT JOIN covered c USING (doc_id)),
bits AS (
  SELECT *, CAST(coalesce(word_sum, 0) AS BIGINT) AS word_chars,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN n_repeat_words * 100 > n_words * 50 THEN 2 ELSE 0 END
    + CASE WHEN coalesce(word_sum, 0) < n_words * 2 OR coalesce(word_sum, 0) > n_words * 15 THEN 4 ELSE 0 END
    + CASE WHEN n_symbols * 100 > n_words * 30 THEN 8 ELSE 0 END
    + CASE WHEN n_dup_lines * 100 > n_lines * 50 THEN 16 ELSE 0 END
    + CASE WHEN n_letters * 100 < coalesce(word_sum, 0) * 60 THEN 32 ELSE 0 END
    + CASE WHEN n_capitals * 100 > n_letters * 50 THEN 64 ELSE 0 END AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM bits
"""


@_query
def op10_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(corpus_samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"), own_terms=True)


@_query
def op6_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = _table(spark, sf_dir, "documents")
    training = docs.filter(~held_out).select(F.col("doc_id").cast("string").alias("key"), "text", "lang")
    found = identify(docs, fit_languages(training))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@_query
def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return graded(docs, fit_grades(docs, grades_of(_table(spark, sf_dir, "labels"))))


@_query
def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"), max_repeat=2.0)


@_query
def op8_union_free_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_texts(pages, host_wrappers(pages))


@_query
def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(_table(spark, sf_dir, "conversations"))


ORACLE["op1_perspective_rotation"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
seen AS (
  SELECT t.*, s.speaker, t.role = s.speaker AS own,
    '<|im_start|>' || CASE WHEN t.role = 'system' THEN t.role WHEN t.role = s.speaker THEN 'assistant'
      ELSE 'user name=' || t.role END || chr(10) || t.text || '<|im_end|>' || chr(10) AS segment
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, length(segment) AS length, row_number() OVER w - 1 AS position,
    CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS start
  FROM seen WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, position, role, segment, start, length,
  CASE WHEN own THEN start + length('<|im_start|>assistant') + 1 END AS mask_start,
  CASE WHEN own THEN start + length - 1 END AS mask_end
FROM placed
"""


@_query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


@_query
def op12_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every call counts all texts."""
    cache = f"{staging_folder(spark)}/quarterline-{spark.sparkContext.applicationId}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), cache)


@_query
def op13_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def _nearest(books: str) -> str:
    return f"""
  SELECT p, vec_id, any_value(label) AS label, any_value(part) AS part, min(d) AS d, arg_min(e, d * 64 + e) AS e
  FROM (
    SELECT p, vec_id, label, part, e,
      CAST(list_sum(list_transform(range(1, len(part) + 1), lambda k: (part[k] - entry[k]) * (part[k] - entry[k]))) AS BIGINT) AS d
    FROM parts JOIN {books} USING (p))
  GROUP BY p, vec_id"""


def _means(near: str, books: str) -> str:
    return f"""
  SELECT p, e, coalesce(fresh, entry) AS entry
  FROM {books} LEFT JOIN (
    SELECT p, e, list(mean ORDER BY k) AS fresh
    FROM (
      SELECT p, e, k, CAST(floor(sum(v) / count(*)) AS BIGINT) AS mean
      FROM (SELECT p, e, unnest(part) AS v, unnest(range(len(part))) AS k FROM {near}) GROUP BY p, e, k)
    GROUP BY p, e) USING (p, e)"""


ORACLE["op13_dual_tree_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS part
  FROM kept, (SELECT unnest(range(16)) AS p)),
books0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry
  FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64),
near0 AS ({_nearest("books0")}),
books1 AS ({_means("near0", "books0")}),
near1 AS ({_nearest("books1")}),
books2 AS ({_means("near1", "books1")}),
near2 AS ({_nearest("books2")}),
spelled AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(entry) AS v, unnest(range(len(entry))) AS k FROM books2)),
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, spelled
"""
