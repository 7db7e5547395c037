"""Rule ledger: every rule is evaluated once per document and kept as a bit.

``ledger`` measures each text and stores the bits of the rules it fails next to the
measurements. A policy is a mask of rules under a version name; ``apply_policy`` and
``ablations`` work on the bits alone, so a new policy needs no second look at the texts.
Built-in functions only; no row leaves its task before the ablation counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
_WHITE_CHARS = " \t\n\x0b\x0c\r"


def _rules() -> dict[str, Column]:
    """Rule name to the condition under which a document fails it; integers only.

    The order is the order of bits: append, never reorder, or stored ledgers change meaning.
    """
    of = F.col
    return {
        "too_few_words": of("n_words") < 50,
        "repeated_words": of("n_repeat_words") * 100 > of("n_words") * 50,
        "short_or_long_words": (of("word_chars") < of("n_words") * 2) | (of("word_chars") > of("n_words") * 15),
        "symbols": of("n_symbols") * 100 > of("n_words") * 30,
        "repeated_lines": of("n_dup_lines") * 100 > of("n_lines") * 50,
        "few_letters": of("n_letters") * 100 < of("word_chars") * 60,
        "shouting": of("n_capitals") * 100 > of("n_letters") * 50,
    }


RULES = (
    "too_few_words", "repeated_words", "short_or_long_words", "symbols", "repeated_lines",
    "few_letters", "shouting",
)
#: policy versions: the rules that reject
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": RULES,
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals",
)


def policy_mask(version: str) -> int:
    return sum(1 << RULES.index(name) for name in POLICIES[version])


def _without(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", pattern, ""))


def _repeat_words() -> Column:
    """Words that lie in a 3-word window found twice or more, first windows included.

    ``windows`` holds a 64-bit hash per window. Only rows that have a repeated one go on: they
    sort numbers made of a hash's lower bits above the window's position, neighbours with
    equal hashes are the repeated windows, and in order of position each adds the words that
    the one before did not cover.
    """
    n = F.size("windows")
    bits = F.length(F.bin(n))
    position = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    tagged = F.sort_array(F.transform(
        "windows", lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("bigint"))))
    alike = F.filter(
        F.zip_with(
            tagged, F.slice(tagged, 2, n),
            lambda a, b: F.when(
                F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0, F.array(a, b))),
        lambda pair: pair.isNotNull())
    at = F.sort_array(F.array_distinct(F.transform(F.flatten(alike), lambda x: x.bitwiseAND(position))))
    steps = F.zip_with(at, F.slice(at, 2, n), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)
    return F.when(F.size(F.array_distinct("windows")) < n, covered).otherwise(0)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements (long) and ``fail_bits`` (long), one row per row of ``docs``.

    Words are runs of characters other than space and 0x09-0x0D. A NULL text counts as empty
    and fails the rules that an empty text fails: every measurement is 0. Repeated
    rows give repeated results; other columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(_WHITE_CHARS))
    worded = texts.withColumns({
        "words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE)),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length("text") - _without(r"[#*$%&|<>]+")).cast("bigint"),
        "n_letters": _without(r"[^\p{L}]+").cast("bigint"),
        "n_capitals": _without(r"[^\p{Lu}]+").cast("bigint"),
    })
    n = F.size("words")
    windows = F.zip_with(
        F.zip_with("words", F.slice("words", 2, n), lambda a, b: F.xxhash64(a, b)),
        F.slice("words", 3, n), lambda ab, c: F.xxhash64(ab, c))
    measured = worded.select(
        "doc_id", F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), "n_symbols", "n_letters", "n_capitals",
        n.cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.slice(windows, 1, F.greatest(n - 2, F.lit(0))).alias("windows"),
    )
    measured = measured.withColumn("n_repeat_words", _repeat_words()).drop("windows")
    bits = F.lit(0).cast("bigint")
    for place, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(_rules()[name], F.lit(1 << place)).otherwise(F.lit(0)).cast("bigint"))
    return measured.select("doc_id", *MEASURES, bits.alias("fail_bits"))


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """``rows`` of a ledger with ``kept``: none of the policy's rules failed."""
    mask = F.lit(policy_mask(version)).cast("bigint")
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(mask) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and kept without it.

    Documents are first counted by their bits, at most 2 ** rules groups; the rules
    unfold over those groups.
    """
    mask = policy_mask(version)
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(
        F.count("*").alias("docs"))
    names = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES.index(name)).cast("bigint").alias("bit"))
        for name in POLICIES[version]
    ])
    each = groups.select("bits", "docs", F.explode(names).alias("rule"))
    bit = F.col("rule.bit")

    def docs_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("docs")).otherwise(0))

    return each.groupBy(F.col("rule.rule").alias("rule")).agg(
        docs_where(F.col("bits").bitwiseAND(bit) != 0).alias("failed"),
        docs_where(F.col("bits") == bit).alias("failed_alone"),
        docs_where(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"),
    )
