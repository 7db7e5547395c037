"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.session import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _are_stars(links: DataFrame) -> bool:
    """Whether every id hangs on one other alone, and on none that hangs itself: no round would change that."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(
        links.select(F.col("b").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    places = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not places.filter("hangs > 1 OR (hangs = 1 AND holds = 1)").agg(F.count("*")).head()[0]


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b); the component is its smallest id.

    Each round hangs the larger neighbours of every id on its smallest neighbour, then
    the smaller ones likewise. Links turn into stars in a number of rounds that grows with
    the logarithm of the longest path. Every round is a staged table; only the number of ids that are
    not in place yet reaches the driver. A hub's links meet in a sort-merge join,
    which adaptive execution can split. Empty links give an empty table; self-links and
    repeated links change nothing.

    With ``rounds``, it stops after so many: ids with one label are connected, but a component may still
    have several. Links that are stars already need one.
    """
    stars = stage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    done = 0
    while rounds or not _are_stars(stars):
        near = _both_ways(stars)
        low = near.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            near.join(low, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        )
        # a link comes as often as its two ends have links to it at most: the second half drops repeats
        large = stage(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = stage(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct())
        done += 1
        if done == rounds:
            stars = stars.groupBy("a").agg(F.min("b").alias("b"))
            break
    labels = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    own = stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return labels.unionAll(own.join(labels, "id", "left_anti") if rounds else own)
