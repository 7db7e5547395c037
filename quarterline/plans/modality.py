"""Contribution of testing modalities over time, on a gap-free grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions import classify
from quarterline.operators.aggregate import category_order, sum_across
from quarterline.operators.grid import complete_series
from quarterline.operators.ordered import fill_up
from quarterline.operators.reshape import reshape_long
from quarterline.operators.shares import (
    period_totals, share_of_group, share_of_period, start_end,
)
from quarterline.session import stage

# What the two reports select and note by default.
INDICATOR = "HTS_TST_POS"
DISAGGREGATE = "Modality/Age/Sex/Result"
BEGIN_PERIOD = "FY20Q1"


def modality_rows(
    df: DataFrame,
    curr_fy: int,
    mod_type: Column,
    indicator: str = INDICATOR,
    disaggregate: str = DISAGGREGATE,
) -> DataFrame:
    """The rows both reports start from, classified."""
    return df.filter(
        (F.col("indicator") == indicator)
        & (F.col("standardizeddisaggregate") == disaggregate)
        & (F.col("fiscal_year") <= curr_fy)
    ).withColumn("mod_type", mod_type)


def modality_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quarterly value per modality group and ``keys``; one row per cell, never NULL.

    The yearly sums are staged, because shares, ranks and the grid all read them.
    """
    wide = stage(sum_across(rows, ["fiscal_year", "mod_type", *keys], "^qtr"))
    return reshape_long(wide).drop("period_type")


def on_grid(
    periods: DataFrame,
    shared: DataFrame,
    keys: Sequence[str],
    colors: Mapping[str, str],
    other_color: str,
    begin_period: str,
    note: str,
) -> DataFrame:
    """Order, complete, fill, total and colour ``shared``, the shares of ``periods``.

    A group has a row for every period up to its last one with data, earlier gaps with NULL
    values. Groups without data, which a full grid would add, have no row to add to a total.
    """
    order = category_order(periods, "mod_type", "value").select(
        F.col("mod_type").alias("_type"), "mod_order"
    )
    ordered = (
        start_end(shared)
        .join(order, F.col("mod_type").eqNullSafe(F.col("_type")), "left")
        .drop("_type")
    )
    grid = complete_series(ordered, ["mod_type", *keys], "period_key", ["period"])
    filled = fill_up(grid, "mod_order", ["mod_type", *keys], "period_key")
    starts = (F.col("mod_type") == "Index") & (F.col("period") == begin_period)
    return (
        period_totals(filled, keys)
        .withColumn("mod_color", classify.lookup(F.col("mod_type"), dict(colors), other_color))
        .withColumn("note", F.when(starts, F.lit(note)))
        .filter(F.col("mod_order").isNotNull())
    )


def modality_by_mech(
    df: DataFrame,
    curr_fy: int,
    begin_period: str = BEGIN_PERIOD,
    rules: Sequence[classify.Rule] = classify.MODALITY_RULES,
    indicator: str = INDICATOR,
    disaggregate: str = DISAGGREGATE,
    mech: str = "mech_name",
) -> DataFrame:
    """Six-way modality report by mechanism; a share is of the whole period."""
    mod_type = classify.modality_type(F.col("modality"), rules)
    rows = modality_rows(df, curr_fy, mod_type, indicator, disaggregate)
    periods = modality_periods(rows, [mech])
    return on_grid(
        periods, share_of_period(periods), [mech], classify.MODALITY_COLORS,
        classify.MODALITY_OTHER_COLOR, begin_period, indicator,
    )


def modality_index(
    df: DataFrame,
    *keys: str,
    curr_fy: int,
    begin_period: str = BEGIN_PERIOD,
    rules: Sequence[classify.Rule] = classify.INDEX_RULES,
    indicator: str = INDICATOR,
    disaggregate: str = DISAGGREGATE,
) -> DataFrame:
    """Index against other testing by the caller's keys; a share is of period and keys."""
    mod_type = classify.index_or_other(F.col("modality"), rules)
    rows = modality_rows(df, curr_fy, mod_type, indicator, disaggregate)
    periods = modality_periods(rows, keys)
    return on_grid(
        periods, share_of_group(periods, keys), keys, classify.INDEX_COLORS,
        classify.INDEX_OTHER_COLOR, begin_period, indicator,
    )
