"""Row predicates and column selection whose NULL handling differs from Spark's default."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(column: Column, values: Iterable) -> Column:
    """Negated membership that keeps NULL rows (SQL ``NOT IN`` would drop them)."""
    return ~F.coalesce(column.isin(*values), F.lit(False))


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    """Column names with a case-insensitive match of ``pattern`` anywhere in them."""
    wanted = re.compile(pattern, re.IGNORECASE)
    return [name for name in df.columns if wanted.search(name)]


def number(column: Column) -> Column:
    """Text to double; what does not parse becomes NULL."""
    return column.try_cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in which a zero denominator gives NULL."""
    return F.try_divide(numerator, denominator)


def null_safe_equal(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Join condition on ``keys`` under which NULL matches NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition
