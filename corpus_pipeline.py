"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept:

1. the ordinal quality model drops documents that it does not select;
2. of every group of near duplicates one document stays;
3. secrets are replaced by a mark; no document goes;
4. sources are read according to temperature weights: the largest once, the others up to twice,
   so that no document is lost;
5. what is left is packed into sequences.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.llm import mixing, ordinal_quality
from quarterline.llm.near_dup import BROADCAST_IDS, near_duplicates
from quarterline.llm.packing import pack_documents
from quarterline.llm.queries import tokenizer_path
from quarterline.llm.secret_scan import corpus_samples, find_secrets, redact, train
from quarterline.session import small_batches, stage

#: a small source is read at most so often
MAX_REPEAT = 2.0
#: words of a run in the near-duplicate stage
WIDTH = 5
#: columns of documents that stages work on
OWN = ("doc_id", "text", "source", "n_chars")


def keeps_columns(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that returns the columns of its documents, with extra ones under spare names while it works."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        spare = [name if name in OWN else f"_extra_{k}" for k, name in enumerate(docs.columns)]
        return function(spark, docs.toDF(*spare), sf_dir).toDF(*docs.columns)

    return run


@keeps_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratings = ordinal_quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal_quality.select(docs, ordinal_quality.fit(docs, ratings))


@keeps_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, by runs of five words, one row.

    Rows are what is compared: two texts under one doc_id go only if they are near duplicates, and so do rows without
    a doc_id. Where ids are unique they name the rows. Otherwise rows are numbered first and staged with
    their numbers, so that every later read sees the same ones. Texts without a word stay.
    """
    unclear = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if unclear.isEmpty():
        return _one_of_each(docs, "doc_id")
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    return _one_of_each(numbered, "_row").drop("_row")


def _one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands for their group; keys are unique."""
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width=WIDTH)
    kept = stage(found.filter("kept").select(F.col("doc_id").alias("_kept")))
    ids = F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept
    return rows.join(ids, F.col(key) == F.col("_kept"), "left_semi")


@keeps_columns
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = redact(find_secrets(docs, train(corpus_samples(docs))))
    return found.withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


@keeps_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.plan(docs, max_repeat=MAX_REPEAT)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: learned models decide in stages 1 and 3: not expressible in SQL, tested by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; rows of the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs)
    return docs
