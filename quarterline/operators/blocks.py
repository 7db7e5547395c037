"""Blocks of an ordered column, so that no order needs one task for the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, column: str, blocks: int) -> list:
    """Ascending cut points that deal the rows of ``df`` into about ``blocks`` ranges.

    Taken from the data by an approximate percentile (one pass over one column), so that
    sparse, clustered and dense keys are cut alike. At most ``blocks - 1`` values reach
    the driver. Empty for an empty table or for one block.
    """
    if blocks < 2:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    accuracy = max(10_000, 20 * blocks)
    found = df.agg(F.percentile_approx(column, shares, accuracy).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_block(column: Column, bounds: list) -> Column:
    """Number of the range of ``column``: how many bounds are at or below it; NULL is 0.

    Bounds are compared in two steps of about the square root of their number each.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse = bounds[step - 1::step]
    cuts = F.lit(bounds)
    above = F.size(F.filter(F.lit(coarse), lambda cut: cut <= column)) * step
    rest = F.slice(cuts, above + 1, F.lit(step))
    found = above + F.size(F.filter(rest, lambda cut: cut <= column))
    return F.when(column.isNull(), F.lit(0)).otherwise(found)
