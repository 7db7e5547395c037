"""Token counts of whole texts, kept in a table by digest of content and of tokenizer.

The table is a folder of Parquet files, one sub-folder per tokenizer digest:

    <cache>/tokenizer=<digest>/part-...parquet      content_digest binary, n_tokens bigint

Counting texts joins their digests to it, encodes one text per missing digest, appends the new counts
in one commit, and reads every count from the table. A failed run appends nothing, a run
repeated after success finds all its counts there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.session import stage

LIMIT = 4096
#: missing digests up to which their list is sent to the texts (32 bytes each); a longer one meets them in a shuffle
BROADCAST_DIGESTS = 200_000
#: distinct words a worker remembers before it starts afresh, and bytes up to which it remembers one
WORDS, WORD_BYTES = 400_000, 64
#: words encoded in one call
_CALL = 10_000

_STORED = "content_digest binary, n_tokens bigint"
#: how the model spells a space
_SPACE = "▁"
_MARK = _SPACE.encode()
#: a run of spaces with the word behind it
_WORD = re.compile(rb" +[^ ]*")


class PieceCounter:
    """Number of pieces of texts by a sentencepiece model.

    Where the model leaves texts as they are, starts them with a space, and no piece has a space behind another character,
    pieces never reach from one word into the next: the count of a text is the sum over its words, and each
    distinct word is encoded once. Any other model encodes every text as a whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        special = [p for i, p in enumerate(pieces) if not (
            self._model.is_control(i) or self._model.is_unknown(i) or self._model.is_byte(i))]
        samples = ["", " ", "a", " a  b ", "ａ\tb\r\n ﬁ x̄ ", " 　 é é "]
        plain = all(self._model.normalize(x) == (_SPACE * bool(x) + x).replace(" ", _SPACE) for x in samples)
        self.by_word = plain and _SPACE in pieces and not any(_SPACE in p.lstrip(_SPACE) for p in special)
        self._known: dict[bytes, int] = {}

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [len(self._model.encode(text)) for text in texts]
        found = []
        for text in texts:
            words = _WORD.findall(b" " + text.replace(_MARK, b" ")) if text else []
            numbers = list(map(self._known.get, words, repeat(-1)))
            if -1 in numbers:
                missing = list({word for word, number in zip(words, numbers) if number < 0})
                for at in range(0, len(missing), _CALL):
                    part = missing[at: at + _CALL]
                    # the model puts the first space before each word itself; a single space is one piece
                    counted = [len(self._model.encode(word[1:])) or 1 for word in part]
                    fresh = dict(zip(part, counted))
                    if len(self._known) + len(fresh) > WORDS:
                        self._known.clear()
                    self._known.update((word, n) for word, n in fresh.items() if len(word) <= WORD_BYTES)
                    numbers = [fresh.get(word, n) if n < 0 else n for word, n in zip(words, numbers)]
            found.append(sum(numbers))
        return found


_counters: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """One per worker process and file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file, of the library's version and of the way it is called."""
    import sentencepiece

    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    # raise the number when counts change for a reason that lies in this module
    return hashlib.sha256(f"{content} sentencepiece {sentencepiece.__version__} counts 1".encode()).hexdigest()


def _content(text: str) -> Column:
    """The text the way the model reads it: NULL is empty, a written space mark is a space."""
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE), F.lit(" "))


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _folder(cache: str, version: str) -> str:
    return f"{cache.rstrip('/')}/tokenizer={version}"


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content_digest, n_tokens) of one tokenizer, one row per digest.

    Two runs may have appended the same digest at one time; their counts are equal.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(cache, version))
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _STORED)
    rows = spark.read.schema(_STORED).parquet(_folder(cache, version))
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for part in parts:
            counts = counter.counts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def _one_text_each(rows: DataFrame, missing: DataFrame, distinct: int) -> DataFrame:
    """(content_digest, content) with one text for each digest of ``missing``.

    Copies meet in the task that reads them before they are shuffled, so a text that a third of all rows has
    is sent once per task.
    """
    count = missing.count()
    if count < distinct:
        rows = rows.join(F.broadcast(missing) if count <= BROADCAST_DIGESTS else missing, "content_digest", "left_semi")
    return rows.groupBy("content_digest").agg(F.first("content").alias("content"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a sentencepiece model on every machine, ``cache`` a folder all of them share; see the module. Counts are
    those of the library without begin or end marks, of the whole text. A NULL or empty text has 0 bytes and
    0 tokens. Every row is returned, repeated ones and those without a doc_id too; other columns are ignored;
    an empty table gives an empty result. Texts are read twice: for digests, and for what is missing.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    content = _content("text")
    keyed = stage(docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), _digest(content).alias("content_digest")))
    wanted = stage(keyed.groupBy("content_digest").agg(F.count("*").alias("copies")))
    missing = stage(wanted.join(stored_counts(spark, cache, version), "content_digest", "left_anti").select("content_digest"))
    rows = docs.select(_digest(content).alias("content_digest"), content.cast("binary").alias("content"))
    fresh = _one_text_each(rows, missing, wanted.count())
    fresh.mapInArrow(_encode(path), _STORED).write.mode("append").parquet(_folder(cache, version))
    counts = stage(wanted.select("content_digest").join(stored_counts(spark, cache, version), "content_digest"))
    return keyed.join(counts, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
