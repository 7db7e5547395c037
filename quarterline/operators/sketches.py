"""Medians of many categories from sketches that are stored and merged.

``exact_median`` suits a few label values. For a category with any number of values (a mechanism), a sketch per
category and year is a small column: it is summed map-side, kept in a table, and merged with those of later years
without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: values a sketch holds before it begins to thin them out
K = 200


def rank_error(k: int = K) -> float:
    """Share of a category's rows by which the rank of a sketched quantile may be off (99 % of cases).

    Up to ``k`` values of a category, a sketch holds all of them and nothing is off.
    """
    return 2.296 / k ** 0.9723


def value_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """``keys`` and ``sketch`` of the non-NULL values of each group; a group without any has no row."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per ``keys`` from several tables or finer groups; merges map-side first."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_quantile(share: float) -> Column:
    """The value of ``sketch`` at a share of the rows: the smallest with at least that share at or below it."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def sketched_medians(sketches: DataFrame, category: str) -> DataFrame:
    """``(category, n, median)`` of merged sketches; the median is the lower one of an even number of values."""
    return sketches.select(category, F.kll_sketch_get_n_double("sketch").alias("n"), sketched_quantile(0.5).alias("median"))


def sketched_order(sketches: DataFrame, category: str, top: int | None = None) -> DataFrame:
    """Medians with ``mod_order``, the rank by falling median, ties by label.

    Ranks of all categories need all of them in one order; with ``top``, only those of the first are found, by a
    bounded sort in every task.
    """
    medians = sketched_medians(sketches, category)
    by = [F.col("median").desc(), F.col(category)]
    if top is not None:
        medians = medians.orderBy(*by).limit(top)
    return medians.withColumn("mod_order", F.row_number().over(Window.orderBy(*by)))
