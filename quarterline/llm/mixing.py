"""Temperature mixing: source shares raised to an exponent, realised as budgeted permutations.

A source's weight is its share of the tokens to the power ``a``, normalised; ``a`` = 1 keeps the shares
and ``a`` = 0 makes all sources equal. The exponent is found by bisection: the largest that reaches a target entropy, but
not so small that a source would be repeated more often than a limit. A source of rate r is read in
whole permutations of its rows, floor(r) times, and in one last permutation that stops when the
rest of its token budget is used. Permutations order rows by a hash of (epoch, doc_id).

The exponent needs two sums over all sources, of t ** a and t ** a * ln t, at the exponents that are tried. Spark adds them
up, for ``CUTS`` exponents in one pass, so that there may be any number of sources.

The stop of the last permutation is a hash value per source. It is found from token sums of (source, block
of hashes) and the rows of one block per source, so a source with a third of all rows is
summed by many tasks, and afterwards every row decides for itself: texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterline.session import shuffle_partitions, stage

#: exponents tried in one pass over the sources
CUTS = 64
#: rows of the plan up to which it is broadcast
BROADCAST_ROWS = 100_000
REPEAT = 2.0
_HALF = 1 << 62


#: sums of share ** a and share ** a * ln(share) at each of some exponents, over sources with tokens
Moments = Callable[[list[float]], list[tuple[float, float]]]


def _edge(holds: Callable[[list[float]], list[bool]]) -> float:
    """The exponent from 0 to 1 at the edge of ``holds``, on the side where it is true; bisection, ``CUTS`` parts at a time."""
    low, high = 0.0, 1.0
    first, last = holds([low, high])
    if first == last:
        return low if first else high
    for _ in range(10):
        inner = [low + (high - low) * k / CUTS for k in range(1, CUTS)]
        cut = next((k for k, held in enumerate(holds(inner)) if held == last), len(inner))
        points = [low, *inner, high]
        low, high = points[cut], points[cut + 1]
    return high if last else low


def exponent_for(
    moments: Moments, largest: float, smallest: float, total: float, target_entropy: float | None = None,
    max_repeat: float | None = REPEAT, budget: float | None = None,
) -> float:
    """Exponent for sources of which the largest and smallest with tokens are given.

    Bisection between 0 and 1, since entropy falls and repetition of small sources falls as the exponent
    grows. With a target entropy, the largest exponent that reaches it; with a repetition limit, never below the
    smallest exponent that keeps to it; with the limit alone, that smallest exponent.
    """
    def within(exponents: list[float]) -> list[bool]:
        # the smallest source is read most often
        if budget is None:
            most = [(largest / smallest) ** (1 - a) for a in exponents]
        else:
            most = [(smallest / total) ** a / power * budget / smallest for a, (power, _) in zip(exponents, moments(exponents))]
        return [repeat <= max_repeat + 1e-9 for repeat in most]

    def reached(exponents: list[float]) -> list[bool]:
        return [math.log(power) - a * logs / power >= target_entropy for a, (power, logs) in zip(exponents, moments(exponents))]

    least = _edge(within) if max_repeat is not None else 0.0
    if target_entropy is not None:
        return max(least, _edge(reached)) if reached([0.0])[0] else least
    return 1.0 if max_repeat is None else least


def rates(
    tokens: dict[str | None, int], target_entropy: float | None = None, max_repeat: float | None = REPEAT,
    budget: float | None = None,
) -> tuple[float, dict[str | None, float]]:
    """(exponent, times each source is read) for token counts per source; a source without tokens is read once."""
    counts = [float(count) for _, count in sorted(tokens.items(), key=lambda item: (item[0] is not None, item[0])) if count]
    if not counts:
        return 1.0, dict.fromkeys(tokens, 1.0)
    total = sum(counts)

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        raised = [[(t / total) ** a for t in counts] for a in exponents]
        return [(sum(line), sum(x * math.log(t / total) for x, t in zip(line, counts))) for line in raised]

    exponent = exponent_for(moments, max(counts), min(counts), total, target_entropy, max_repeat, budget)
    power = moments([exponent])[0][0]

    def rate(t: float) -> float:
        return (t / max(counts)) ** (exponent - 1) if budget is None else (t / total) ** exponent / power * budget / t

    return exponent, {name: rate(float(t)) if t else 1.0 for name, t in tokens.items()}


def word_count(text: Column) -> Column:
    """Words of a text, the tokens that mixing counts; 0 for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def _order(epoch: Column) -> Column:
    """Place of a row in the permutation of an epoch, below 2 ** 62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), epoch.cast("int"), "doc_id"), 2)


def _rated(
    sums: DataFrame, target_entropy: float | None = None, max_repeat: float | None = REPEAT, budget: float | None = None,
) -> DataFrame:
    """source, exponent, rate, epochs, rest (tokens of the last permutation) from (source, tokens)."""
    count = F.col("tokens").cast("double")
    total, largest, smallest = sums.filter("tokens > 0").agg(F.sum(count), F.max(count), F.min(count)).head()
    exponent, rate = 1.0, F.lit(1.0)
    if total:
        share = count / F.lit(total)

        def moments(exponents: list[float]) -> list[tuple[float, float]]:
            powers = [F.pow(share, F.lit(a)) for a in exponents]
            found = sums.filter("tokens > 0").agg(*(F.sum(x) for x in powers), *(F.sum(x * F.log(share)) for x in powers)).head()
            return list(zip(found[: len(exponents)], found[len(exponents):]))

        exponent = exponent_for(moments, largest, smallest, total, target_entropy, max_repeat, budget)
        if budget is None:
            rate = F.pow(count / F.lit(largest), F.lit(exponent - 1))
        else:
            rate = F.pow(share, F.lit(exponent)) / F.lit(moments([exponent])[0][0]) * F.lit(float(budget)) / count
        rate = F.when(count > 0, rate).otherwise(F.lit(1.0))
    rated = sums.select("source", "tokens", F.lit(exponent).alias("exponent"), rate.alias("rate"))
    rated = rated.withColumn("epochs", F.floor(F.col("rate") + 1e-9).cast("int"))
    rest = F.greatest(F.round((F.col("rate") - F.col("epochs")) * F.col("tokens")).cast("bigint"), F.lit(0).cast("bigint"))
    return rated.withColumn("rest", rest).drop("tokens")


def plan(docs: DataFrame, **targets) -> DataFrame:
    """Per source: exponent, rate, epochs (whole permutations), and ``stop``, the order in epoch ``epochs`` from which
    rows are left out."""
    spark = docs.sparkSession
    rows = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens")))
    sources = stage(_rated(stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))), **targets))
    blocks = 4 * shuffle_partitions(spark)
    width = -(-_HALF // blocks)
    small = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    last = rows.join(
        small.filter("rest > 0").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    ).withColumn("order", _order(F.col("epochs"))).withColumn("block", F.expr(f"order div {width}")).select(
        "source", "rest", "order", "block", "n_tokens")
    per_block = last.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("tokens"))
    ahead = F.sum("tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("tokens")
    edge = per_block.withColumn("ahead", ahead).filter(
        (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("tokens") >= F.col("rest")))
    edge = edge.select(F.col("source").alias("of"), F.col("block").alias("edge"), "ahead")
    inside = last.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("edge")))
    before = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("order")) - F.col("n_tokens") + F.col("ahead")
    # rows of one order are taken together: the sum up to them includes all of them
    stops = inside.withColumn("before", before).filter(F.col("before") < F.col("rest")).groupBy("source").agg(
        (F.max("order") + 1).alias("stop"))
    stops = stage(stops.select(F.col("source").alias("of"), "stop"))
    return sources.join(stops, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "exponent", "rate", "epochs", F.coalesce("stop", F.lit(0)).alias("stop"))


def mix(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``docs`` once per reading, with ``epoch`` from 0 and ``position`` from 0 to 1.

    Sorted by position, every stretch holds the sources in about their weights. A NULL source is a source of its own;
    repeated rows are read together. The number of sources decides whether the plan is broadcast.
    """
    spare = ("_of", "_rate", "_epochs", "_stop")
    small = sources.select(
        F.col("source").alias("_of"), F.col("rate").alias("_rate"), F.col("epochs").alias("_epochs"), F.col("stop").alias("_stop"))
    if sources.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    readings = F.col("_epochs") + F.when(_order(F.col("_epochs")) < F.col("_stop"), 1).otherwise(0)
    epochs = F.filter(F.sequence(F.lit(0), F.greatest(readings - 1, F.lit(0))), lambda e: e < readings)
    read = docs.drop("epoch", "position").join(small, F.col("source").eqNullSafe(F.col("_of"))).withColumn("epoch", F.explode(epochs))
    place = (F.col("epoch") + _order(F.col("epoch")) / F.lit(float(_HALF))) / F.col("_rate")
    return read.withColumn("position", F.least(place, F.lit(1.0))).drop(*spare)


def mixed(docs: DataFrame, **targets) -> DataFrame:
    """Per reading of a row of ``docs``: doc_id, source, n_tokens, epoch, position.

    NULL and empty texts have no tokens and are read like the rest of their source. An empty table gives an empty one.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"))
    return mix(rows, plan(docs, **targets)).select("doc_id", "source", "n_tokens", "epoch", "position")
