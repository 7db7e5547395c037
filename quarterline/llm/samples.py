"""Bounded samples of rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows chosen by a hash of ``key``; all of them where there are fewer.

    One count decides the share; the same rows come out for any partitioning. A NULL key counts as one value.
    """
    total = rows.count()
    if total <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(_SPAN)) < size * _SPAN // total)
