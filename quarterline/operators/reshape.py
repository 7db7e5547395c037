"""Quarters to periods, wide targets, presentation order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.labels import period_key, period_label, year_label
from quarterline.functions.predicates import matching_columns
from quarterline.operators.aggregate import total
from quarterline.schemas import QUARTERS
from quarterline.session import stage

MEASURES = r"^(qtr[1-4]|targets|cumulative)$"


def reshape_long(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Wide measures to ``(period, period_key, period_type, value)``.

    Quarters become ``results`` of ``FYyyQq``; ``targets`` and ``cumulative`` keep the
    year as their period and sort with its last quarter. NULL values are dropped,
    zeros are kept, and ``fiscal_year`` is replaced by the period.
    """
    measures = matching_columns(df, MEASURES)
    ids = list(keep) if keep is not None else [
        name for name in df.columns if name not in (*measures, "fiscal_year")
    ]
    year = F.col("fiscal_year")
    is_quarter = F.col("_measure").startswith("qtr")
    quarter = F.when(is_quarter, F.right(F.col("_measure"), F.lit(1)).try_cast("int")).otherwise(4)
    return (
        df.unpivot(["fiscal_year", *ids], measures, "_measure", "value")
        .filter(F.col("value").isNotNull())
        .select(
            *ids,
            F.when(is_quarter, period_label(year, quarter)).otherwise(year_label(year)).alias("period"),
            period_key(year, quarter).alias("period_key"),
            F.when(is_quarter, F.lit("results")).otherwise(F.col("_measure")).alias("period_type"),
            "value",
        )
    )


def reshape_quarters(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per quarter: ``(period, period_key, results, results_cumulative, targets)``.

    The year's target repeats on each quarter; the running result is taken across
    the quarter columns, inside the row, so that it needs no window.
    """
    ids = list(keep) if keep is not None else [
        name for name in df.columns
        if name not in (*QUARTERS, "targets", "cumulative", "fiscal_year")
    ]
    year = F.col("fiscal_year")
    running = F.lit(0.0)
    quarters = []
    for q, name in enumerate(QUARTERS, 1):
        running = running + F.coalesce(F.col(name), F.lit(0.0))
        quarters.append(
            F.struct(
                period_label(year, F.lit(q)).alias("period"),
                period_key(year, F.lit(q)).alias("period_key"),
                F.col(name).alias("results"),
                running.alias("results_cumulative"),
            )
        )
    return df.select(*ids, "targets", F.inline(F.array(*quarters))).select(
        *ids, "period", "period_key", "results", "results_cumulative", "targets"
    )


#: columns a pivot may have, and what a NULL name is called there
MOST_NAMES, NO_NAME = 1000, "NA"


def pivot_sum(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, names: Sequence[str] = ()
) -> DataFrame:
    """Sum to one column per value of ``names_from``; a combination with no row at all stays NULL.

    Listed names come first and in their order, with a column even where no row has them.
    Values that are not listed follow, sorted, and NULL as ``NA``: nothing is left out. The table is
    summed and staged before its names are read, so it is derived once; more than ``MOST_NAMES`` names raise.
    """
    df = stage(df.groupBy(*ids, names_from).agg(F.sum(values_from).alias(values_from)))
    found = [row[0] for row in df.select(names_from).distinct().limit(MOST_NAMES + 1).collect()]
    if len(found) > MOST_NAMES:
        raise ValueError(f"{names_from} has more than {MOST_NAMES} values")
    columns = list(names) + sorted({NO_NAME if name is None else name for name in found} - set(names))
    named = df.withColumn(names_from, F.coalesce(names_from, F.lit(NO_NAME)))
    wide = named.groupBy(*ids).pivot(names_from, columns).agg(total(values_from))
    return wide.select(*ids, *[F.col(f"`{name}`").cast("double") for name in columns])


def level_rank(column: Column, levels: Sequence[str]) -> Column:
    """Position in a level list, NULL for a text that is not listed."""
    position = F.array_position(F.array(*map(F.lit, levels)), column)
    return F.nullif(position, F.lit(0)).cast("int")


def custom_order(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Sort by a level list, unlisted texts last; ``sort_key`` keeps the order after a write."""
    return df.withColumn("sort_key", level_rank(F.col(column), levels)).orderBy(
        F.col("sort_key").asc_nulls_last(), F.col(column)
    )
