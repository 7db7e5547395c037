"""Shares of totals, period totals, first and last period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterline.functions.predicates import ratio


def share_of_period(df: DataFrame, value: str = "value", name: str = "contribution") -> DataFrame:
    """Share of each row in the total of its period, over all other keys.

    A window over the period would send a whole period to one task. The totals are
    aggregated instead; a fiscal year adds four rows to them, so they are broadcast.
    """
    totals = df.groupBy(F.col("period_key").alias("_key")).agg(F.sum(value).alias("_total"))
    return (
        df.join(F.broadcast(totals), F.col("period_key").eqNullSafe(F.col("_key")), "left")
        .withColumn(name, ratio(F.col(value), F.col("_total")))
        .drop("_key", "_total")
    )


def share_of_group(
    df: DataFrame, keys: Sequence[str], value: str = "value", name: str = "contribution"
) -> DataFrame:
    """Share in the total of period and caller keys.

    The input holds one row per category there, so a window group stays small.
    """
    group = Window.partitionBy("period_key", *keys)
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(group)))


def start_end(df: DataFrame, column: str = "contribution") -> DataFrame:
    """Repeat ``column`` as ``start`` in the first period and as ``end`` in the last one."""
    first = df.agg(F.min("period_key")).scalar()
    last = df.agg(F.max("period_key")).scalar()
    return df.withColumn(
        "start", F.when(F.col("period_key") == first, F.col(column))
    ).withColumn("end", F.when(F.col("period_key") == last, F.col(column)))


def period_totals(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Total per period and keys on each row, with its 25, 50 and 75 % marks."""
    group = Window.partitionBy("period_key", *keys)
    out = df.withColumn("pd_tot", F.coalesce(F.sum(value).over(group), F.lit(0.0)))
    for percent in (25, 50, 75):
        out = out.withColumn(f"pd_{percent}", F.col("pd_tot") * (percent / 100))
    return out
