"""Achievement reports and the tables behind their figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.functions.classify import Bands
from quarterline.functions.labels import clean_agency
from quarterline.operators.achievement import (
    add_achievement_label, add_chart_labels, add_ratio, adorn_achievement, brief,
    calc_achievement,
)
from quarterline.operators.aggregate import sum_across, sum_two_grains
from quarterline.operators.reshape import reshape_quarters
from quarterline.schemas import TOTAL_NUMERATOR, Metadata
from quarterline.sources.snapshots import write_by

QUARTERS_AND_TARGETS = "targets|qtr"


def _years(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """Total numerators of the years; agencies under their clean names, before any filter or group."""
    return df.filter(
        (F.col("standardizeddisaggregate") == TOTAL_NUMERATOR)
        & F.col("fiscal_year").isin(*years)
    ).withColumn("funding_agency", clean_agency(F.col("funding_agency")))


def quarterly_achievement(
    df: DataFrame, indicators: Sequence[str], years: Sequence[int], agency: str | None = None
) -> DataFrame:
    """Results, targets and their ratio by quarter; for one agency or for all together."""
    rows = _years(df, years).filter(F.col("indicator").isin(*indicators))
    keys = ["fiscal_year", "indicator"]
    if agency is not None:
        rows = rows.filter(F.col("funding_agency") == agency)
        keys.append("funding_agency")
    return add_ratio(reshape_quarters(sum_across(rows, keys, QUARTERS_AND_TARGETS)))


def achievement_grouping_sets(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """The same for every indicator, all agencies and each agency, from one aggregation."""
    sums = sum_two_grains(
        _years(df, years), ["fiscal_year", "indicator"], "funding_agency", QUARTERS_AND_TARGETS
    )
    return add_ratio(reshape_quarters(sums))


def chart_current(
    df: DataFrame, indicators: Sequence[str], years: Sequence[int], metadata: Metadata,
    agency: str | None = None,
) -> DataFrame:
    """Current period with its labels, title and caption."""
    name = " & ".join(indicators)
    title = f"{name} ACHIEVEMENT | {agency or 'ALL AGENCIES'}: {metadata.curr_pd}"
    now = quarterly_achievement(df, indicators, years, agency).filter(
        F.col("period") == metadata.curr_pd
    )
    return add_chart_labels(now).withColumns(
        {"title": F.lit(title), "caption": F.lit(metadata.caption)}
    )


def chart_trend(
    df: DataFrame, indicators: Sequence[str], years: Sequence[int], periods: Sequence[str],
    agency: str, unlabelled: str,
) -> DataFrame:
    """Chosen periods of one agency; ``unlabelled`` shows its target without a label."""
    series = quarterly_achievement(df, indicators, years, agency).filter(
        F.col("period").isin(*periods)
    )
    return add_chart_labels(series).withColumn(
        "targets_label",
        F.when(F.col("period") != unlabelled, F.col("targets_label")),
    )


def achievement_by_mech(
    df: DataFrame,
    indicators: Sequence[str],
    metadata: Metadata,
    agencies_out: Sequence[str] = ("DEDUP",),
    names_out: Sequence[str] = (),
    codes_out: Sequence[str] = (),
) -> DataFrame:
    """Cumulative results against targets per mechanism and indicator, with exclusions.

    The exclusions also leave out rows whose agency, name or code is unknown.
    """
    rows = _years(df, [metadata.curr_fy]).filter(F.col("indicator").isin(*indicators))
    for column, values in (
        ("funding_agency", agencies_out), ("mech_name", names_out), ("mech_code", codes_out),
    ):
        for value in values:
            rows = rows.filter(F.col(column) != value)
    keys = ["fiscal_year", "mech_code", "mech_name", "funding_agency", "indicator"]
    return calc_achievement(sum_across(rows, keys, "cumul|targets"))


def achievement_table(
    df: DataFrame, indicators: Sequence[str], metadata: Metadata, bands: Bands = Bands(),
    **exclusions: Sequence[str],
) -> DataFrame:
    """The same with its band and the ``12K / 20K`` label."""
    table = achievement_by_mech(df, indicators, metadata, **exclusions)
    return add_achievement_label(adorn_achievement(table, metadata.curr_qtr, bands))


def _brief_years(metadata: Metadata) -> list[int]:
    """The current year, and the one before only when the quarter before lies in it."""
    years = [metadata.curr_fy]
    return [metadata.curr_fy - 1, *years] if metadata.curr_qtr == 1 else years


def period_brief(
    df: DataFrame, metadata: Metadata, indicators: Sequence[str] | None = None
) -> DataFrame:
    """Current quarter per indicator, each agency and all of them."""
    rows = _years(df, _brief_years(metadata))
    if indicators is not None:
        rows = rows.filter(F.col("indicator").isin(*indicators))
    return brief(rows, ["indicator"], metadata)


def mech_summary(df: DataFrame, metadata: Metadata) -> DataFrame:
    """The brief of every mechanism at once, with its title."""
    rows = _years(df, _brief_years(metadata))
    table = brief(rows, ["mech_code", "mech_name", "indicator"], metadata)
    return table.withColumn(
        "title", F.concat(F.col("mech_name"), F.lit(" PERFORMANCE SUMMARY"))
    )


def write_mech_summaries(df: DataFrame, metadata: Metadata, path: str) -> None:
    """One output folder per mechanism, all written by one job."""
    write_by(mech_summary(df, metadata), path, "mech_code")
