"""Secrets in texts: stated patterns, and character Markov models for what no pattern names.

Two first-order Markov models give each character the chance that it follows the one before:
one learned from random strings, one from ordinary identifiers. A long token is a
secret when the log-likelihood ratio of the two says "random". Both come from
labelled samples and reach the scan as one table of alphabet times alphabet numbers.

Built-in functions only. Every text is scanned in its own row; nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.llm.samples import hash_sample

#: kind to pattern, smallest length, and the group the length is of; fixed values
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = {"assign": (ASSIGN, 6, 2), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]+", 24, 0)}
#: a pattern that every text with a span of the kind matches, cheap to look for first
_HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
}
KINDS = ("assign", "access", "hex", "markov")
#: tokens the Markov models judge
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_-]{{{LEAST},}}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: documents from which ordinary identifiers are taken when fitting
SAMPLE_DOCS = 200
#: a token is a secret with at least this log-likelihood ratio per character
THRESHOLD = 0.5

_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans_of(kind: str, pattern: str, least: int, group: int, text: str = "text") -> Column:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    The pieces between matches and the matches themselves alternate, so their lengths add
    up to the places. Code points, end exclusive.
    """
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rank = KINDS.index(kind)
    rows = F.arrays_zip(
        F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("hit"), part.alias("part"))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        found = F.when(F.length(row["part"]) >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.cast(f"array<{_SPAN}>").alias("found"))

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.aggregate(rows, start, step, lambda state: state["found"])


def _codes(text: Column) -> Column:
    """Places of a text's characters in the alphabet, from 1; 0 for any other."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(codes: Column) -> Column:
    """Numbers of the pairs of neighbours; the first character follows 0."""
    n = len(ALPHABET) + 1
    before = F.slice(F.concat(F.array(F.lit(0)), codes), 1, F.size(codes))
    return F.zip_with(before, codes, lambda a, b: a * n + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random / ordinary per pair of characters, from (token, is_random).

    Pairs are counted by Spark; at most two rows per pair of characters reach the driver.
    NULL and empty tokens teach nothing. Unseen pairs count as seen half a time.
    """
    n = len(ALPHABET) + 1
    pairs = samples.filter("length(token) > 0").select(
        "is_random", F.explode(_pairs(_codes(F.col("token")))).alias("pair"))
    counts = {False: [0.5] * (n * n), True: [0.5] * (n * n)}
    for row in pairs.groupBy("is_random", "pair").count().collect():
        counts[row["is_random"]][row["pair"]] += row["count"]
    ratios = []
    for first in range(n):
        line = slice(first * n, first * n + n)
        totals = {label: sum(counts[label][line]) for label in counts}
        ratios += [
            math.log(r / totals[True]) - math.log(o / totals[False])
            for r, o in zip(counts[True][line], counts[False][line])
        ]
    return ratios


def corpus_samples(docs: DataFrame, documents: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled tokens (token, is_random) from about ``documents`` rows.

    Ordinary: the corpus' own letter runs, bare, joined by ``_`` or ``-``, and capitalised.
    Random: what the hashes of those words spell in hex, base 64 and capitals with digits.
    """
    words = hash_sample(docs.select("doc_id", "text"), "doc_id", documents).select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("word")).distinct()
    other = F.concat(F.lit("x"), F.col("word"))
    digest = F.unhex(F.sha2("word", 256))
    ordinary = F.array(
        F.col("word"), F.upper("word"), F.concat(F.initcap("word"), F.initcap("word")),
        F.concat_ws("_", "word", "word"), F.concat_ws("-", "word", F.lower("word")))
    random = F.array(
        F.translate(F.base64(digest), "=\r\n", ""), F.sha2(other, 256),
        F.upper(F.conv(F.substring(F.sha2(other, 256), 1, 15), 16, 36)))
    both = words.select(
        F.explode(F.transform(ordinary, lambda t: F.struct(t.alias("token"), F.lit(False).alias("is_random")))).alias("s")
    ).unionAll(words.select(
        F.explode(F.transform(random, lambda t: F.struct(t.alias("token"), F.lit(True).alias("is_random")))).alias("s")))
    return both.select("s.*")


_PIECE = "struct<start:int,rank:int,kind:string,end:int,first:int,past:int>"


def _rest(token: Column, named: Column) -> Column:
    """What the ``named`` spans, in order, leave of a token; each piece with the token's own start and end."""
    met = F.filter(named, lambda s: (s["start"] < token["end"]) & (token["start"] < s["end"]))

    def piece(start: Column, end: Column) -> Column:
        whole = F.struct(
            start.alias("start"), token["rank"].alias("rank"), token["kind"].alias("kind"), end.alias("end"),
            token["start"].alias("first"), token["end"].alias("past"))
        return F.when(start < end, F.array(whole)).otherwise(F.array().cast(f"array<{_PIECE}>")).cast(f"array<{_PIECE}>")

    def step(state: Column, span: Column) -> Column:
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.concat(state["found"], piece(state["at"], span["start"])).alias("found"))

    start = F.struct(token["start"].alias("at"), F.array().cast(f"array<{_PIECE}>").alias("found"))
    return F.aggregate(met, start, step, lambda state: F.concat(state["found"], piece(state["at"], token["end"])))


def _markov(ratios: list[float], named: Column) -> Column:
    """Spans of what ``named`` spans leave of tokens, where the models call the token or the rest random."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    pieces = F.flatten(F.transform(spans_of("markov", TOKEN, 0, 0), lambda token: _rest(token, named)))

    def is_random(start: Column, end: Column) -> Column:
        token = F.substring(F.col("text"), start + 1, end - start)
        total = F.aggregate(_pairs(_codes(token)), F.lit(0.0), lambda sum, pair: sum + F.get(table, pair))
        return total / (end - start) >= THRESHOLD

    found = F.filter(
        pieces, lambda p: is_random(p["first"], p["past"])
        | ((p["end"] - p["start"] < p["past"] - p["first"]) & (p["end"] - p["start"] >= LEAST) & is_random(p["start"], p["end"])))
    return F.transform(found, lambda p: F.struct(p["start"], p["rank"], p["kind"], p["end"])).cast(f"array<{_SPAN}>")


def find_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, kind, end) in order of place.

    Base kinds keep all their spans, which may overlap those of another kind. A token that the models
    call random adds a Markov span for each piece of it that no base span covers; so does a piece of ``LEAST``
    characters or more that is random by itself. A NULL or empty text has no spans. Rows are
    independent: repeated rows and rows without id get their own results, other columns stay, but one that is
    called ``spans`` is replaced.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    base = [
        F.when(F.col("text").rlike(_HINTS[kind]), spans_of(kind, *BASE[kind])).otherwise(none) for kind in BASE
    ]
    named = docs.withColumn("spans", F.sort_array(F.coalesce(F.concat(*base), none)))
    markov = F.when(F.col("text").rlike(TOKEN), _markov(ratios, F.col("spans"))).otherwise(none)
    return named.withColumn("spans", F.sort_array(F.concat("spans", markov)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``find_secrets`` with each span, or run of overlapping spans, of ``text`` replaced."""
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        "spans", start, step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text))
