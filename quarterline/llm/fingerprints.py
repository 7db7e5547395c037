"""I-Match fingerprints: hashes of the informative terms of a text, over random lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band. It is cut at random into
``SUBSETS`` parts, and so is an eighth of it, and a sixty-fourth. Per part, a text's distinct terms are
sorted and hashed; the hashes side by side are the fingerprint. A change of the text only
changes the parts that hold a changed term, so the share of equal parts tells how alike
two texts are, the dense parts for short texts and the sparse ones for long texts.

Built-in functions only. The lexicon reaches the rows as a table of ``BUCKETS`` bytes: its
size is fixed, whatever the corpus. A band from ``LOW`` of all documents upwards holds at most
(distinct terms per document) / ``LOW`` terms, some ten thousand here; a term outside of
the band that shares a bucket with one inside counts as inside, in every text alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterline.operators.blocks import range_block, range_bounds
from quarterline.session import shuffle_partitions

#: shares of the documents between which a term must occur
LOW, HIGH = 0.002, 0.1
BUCKETS = 1 << 20
SUBSETS = 16
LEVELS = 3
#: bits of a term's hash: bucket, then per level the gate to it and the part
_BUCKET_BITS, _PART_BITS, _GATE_BITS = 20, 4, 3
_DIGITS = 6


def term_hashes(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits as sorted 64-bit hashes; none for NULL."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> bytes:
    """One byte per bucket of term hashes, 1 where a term lies in the band.

    Document frequencies are exact and cover all rows; a term must be in two rows at least. At most
    ``BUCKETS`` numbers reach the driver.
    """
    total = docs.count()
    frequency = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    band = frequency.filter((F.col("df") >= max(2, low * total)) & (F.col("df") <= high * total))
    table = bytearray(BUCKETS)
    for row in band.select(F.col("term").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).distinct().toLocalIterator():
        table[row["bucket"]] = 1
    return bytes(table)


def _bits(h: Column, shift: int, count: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << count) - 1).cast("bigint"))


def with_parts(rows: DataFrame, text: str, table: bytes, name: str, own_terms: bool = False) -> DataFrame:
    """``rows`` with ``name``: array of ``LEVELS * SUBSETS`` part hashes, '' for a part without terms.

    With ``own_terms``, a text that has terms but none of the lexicon is cut by all of its terms.
    """
    bucket_bytes = F.lit(bytearray(table))
    place = F.lit(BUCKETS - 1).cast("bigint")
    levels = [f"{name}_level{k}" for k in range(LEVELS)]
    terms = f"{name}_terms"
    rows = rows.withColumn(terms, term_hashes(F.col(text))).withColumn(levels[0], F.filter(
        terms,
        lambda h: F.substring(bucket_bytes, (h.bitwiseAND(place) + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\1"))))
    if own_terms:
        rows = rows.withColumn(levels[0], F.when(F.size(levels[0]) == 0, F.col(terms)).otherwise(F.col(levels[0])))
    shift = _BUCKET_BITS
    shifts = [shift]
    for k in range(1, LEVELS):
        gate = shift + _PART_BITS
        rows = rows.withColumn(levels[k], F.filter(levels[k - 1], lambda h: _bits(h, gate, _GATE_BITS) == 0))
        shift = gate + _GATE_BITS
        shifts.append(shift)

    def part(level: str, shift: int, number: int) -> Column:
        own = F.filter(level, lambda h: _bits(h, shift, _PART_BITS) == number)
        digits = F.lower(F.hex(F.xxhash64(own)))
        return F.when(F.size(own) == 0, F.lit("")).otherwise(F.substring(F.lpad(digits, 16, "0"), 17 - _DIGITS, _DIGITS))

    parts = [part(level, shift, number) for level, shift in zip(levels, shifts) for number in range(SUBSETS)]
    return rows.withColumn(name, F.array(*parts)).drop(terms, *levels)


def spelled(parts: Column) -> Column:
    """The fingerprint as text: every part in ``_DIGITS`` digits, hyphens for one without terms."""
    return F.array_join(F.transform(parts, lambda p: F.rpad(p, _DIGITS, "-")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those with terms on either side, from 0 to 1.

    Levels on which every part has terms on either side are too dense to tell and count only if
    they are the last. Two fingerprints without terms are alike, 1.
    """
    both = F.zip_with(a, b, lambda x, y: F.struct(
        ((x != "") | (y != "")).cast("int").alias("any"), ((x != "") & (x == y)).cast("int").alias("same")))

    def total(level: int, field: str) -> Column:
        rows = F.slice(both, level * SUBSETS + 1, SUBSETS)
        return F.aggregate(rows, F.lit(0), lambda sum, row: sum + row[field])

    filled, same = F.lit(0), F.lit(0)
    for level in range(LEVELS):
        any_ = total(level, "any")
        counts = F.lit(True) if level == LEVELS - 1 else any_ < SUBSETS
        filled += F.when(counts, any_).otherwise(0)
        same += F.when(counts, total(level, "same")).otherwise(0)
    return F.when(a == b, F.lit(1.0)).when(filled == 0, F.lit(0.0)).otherwise(same / filled)


def with_next(docs: DataFrame, prepare, columns: list[str]) -> DataFrame:
    """``prepare(docs)`` with ``next``: a struct of ``columns`` of the row that follows in descending doc_id.

    After the last row comes the first. Rows are ordered inside blocks of doc_id cut at its
    quantiles, so no task holds more than a block; a block's last row takes its values
    from the first row of the block below. One key per block reaches the driver. Rows with equal ids
    follow each other in order of their hashes; NULL ids come last. ``prepare`` adds columns row by row.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = range_bounds(keyed, "_key", 4 * shuffle_partitions(spark))
    placed = keyed.withColumn("_block", range_block(F.col("_key"), bounds))
    tops = sorted(
        (row["_block"], row["top"]) for row in placed.groupBy("_block").agg(F.max("_key").alias("top")).collect())
    above = [tops[(k + 1) % len(tops)][0] for k in range(len(tops))]
    heads = spark.createDataFrame(
        [(block, key) for block, (_, key) in zip(above, tops)], "_block int, _key bigint")
    values = F.struct(*columns)
    rank = F.xxhash64(*columns)
    first = prepare(keyed.join(F.broadcast(heads), "_key")).groupBy("_block").agg(
        F.max(F.struct(rank.alias("rank"), values.alias("values")))["values"].alias("_below"))
    order = [F.col("_key").desc(), rank.desc()]
    ahead = prepare(placed).withColumn(
        "_follows", F.lead(values).over(Window.partitionBy("_block").orderBy(*order)))
    return ahead.join(first, "_block").withColumn("next", F.coalesce("_follows", "_below")).drop(
        "_key", "_block", "_follows", "_below")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by the first as many code points of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, table: bytes | None = None, own_terms: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is ``edited_text`` with the next document's. ``near_edited`` and ``near_next`` are the
    likeness of the fingerprint to the edited text's and to the next document's. A NULL text is an empty one;
    texts without a term of the lexicon have the empty fingerprint and are alike; with ``own_terms`` that holds for texts without
    any term only, and one without a term of the lexicon has the fingerprint of all its terms, so that it is equal to another's
    only if their terms are. Repeated rows have equal fingerprints; other columns are ignored; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = lexicon(docs) if table is None else table
    rows = with_next(docs, lambda rows: with_parts(rows, "text", table, "parts", own_terms), ["text", "parts"])
    rows = rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "parts",
        F.col("next.parts").alias("next_parts"), edited_text(F.col("text"), F.col("next.text")).alias("edited"))
    rows = with_parts(rows, "edited", table, "edited_parts", own_terms)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("parts")).alias("fingerprint"), spelled(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"))
