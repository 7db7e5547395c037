"""Pivoted target tables in a set indicator order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.functions.classify import age_coarse
from quarterline.functions.labels import clean_agency, clean_indicator
from quarterline.functions.predicates import not_in
from quarterline.operators.reshape import custom_order, pivot_sum

# The order in which indicators are presented.
INDICATOR_ORDER = (
    "TX_NEW", "TX_CURR", "TX_PVLS_D", "TX_PVLS", "HTS_SELF", "HTS_TST", "HTS_TST_POS",
    "HTS_RECENT", "HTS_INDEX", "PMTCT_STAT", "PMTCT_STAT_POS", "PMTCT_ART", "PMTCT_EID",
    "TB_STAT", "TB_ART", "TB_PREV", "TX_TB_D", "VMMC_CIRC", "KP_PREV", "PrEP_NEW",
    "PrEP_CT", "CXCA_SCRN", "PP_PREV", "OVC_SERV", "OVC_HIVSTAT", "GEND_GBV", "AGYW_PREV",
)
# Indicators of the prioritisation table, disaggregates it leaves out,
# and indicators of the agency table.
PRIORITIZATION_INDICATORS = ("HTS_TST", "HTS_TST_POS", "HTS_RECENT", "HTS_INDEX")
KEY_POPULATION_DISAGGREGATES = ("KeyPop/Result", "KeyPop/HIVStatus")
AGENCY_INDICATORS = (
    "TX_NEW", "TX_CURR", "TX_PVLS_D", "TX_PVLS", "HTS_SELF", "HTS_TST", "HTS_TST_POS",
    "HTS_RECENT", "HTS_INDEX", "TB_STAT", "TB_ART", "TB_PREV", "TX_TB_D", "PrEP_NEW",
    "PrEP_CT",
)


def with_clean_indicator(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "indicator", clean_indicator(F.col("indicator"), F.col("numeratordenom"))
    )


def _selected(df: DataFrame, year: int, indicators: Sequence[str]) -> DataFrame:
    return with_clean_indicator(df).filter(
        (F.col("fiscal_year") == year) & F.col("indicator").isin(*indicators)
    )


def _with_age(df: DataFrame, ids: list[str], by_age: bool) -> tuple[DataFrame, list[str]]:
    if not by_age:
        return df, ids
    return df.withColumn("trendscoarse", age_coarse(F.col("ageasentered"))), [*ids, "trendscoarse"]


def table_prioritization(
    df: DataFrame,
    year: int,
    prioritizations: Sequence[str] = (),
    indicators: Sequence[str] = PRIORITIZATION_INDICATORS,
    levels: Sequence[str] = INDICATOR_ORDER,
    disaggregates_out: Sequence[str] = KEY_POPULATION_DISAGGREGATES,
    by_age: bool = False,
) -> DataFrame:
    """Targets by indicator and disaggregate, one column per prioritisation, gaps as 0.

    Rows without a disaggregate stay in. Listed prioritisations come first, others follow.
    ``by_age`` adds the coarse age to the keys, as ``trendscoarse``.
    """
    ids = ["fiscal_year", "indicator", "standardizeddisaggregate"]
    rows = _selected(df, year, indicators).filter(
        not_in(F.col("standardizeddisaggregate"), disaggregates_out)
    )
    rows, ids = _with_age(rows, ids, by_age)
    wide = pivot_sum(rows, ids, "snuprioritization", "targets", prioritizations)
    wide = wide.fillna(0.0, subset=[name for name in wide.columns if name not in ids])
    return custom_order(wide, "indicator", levels)


def table_agency(
    df: DataFrame,
    year: int,
    agencies: Sequence[str] = (),
    indicators: Sequence[str] = AGENCY_INDICATORS,
    levels: Sequence[str] = INDICATOR_ORDER,
    clean: bool = True,
    by_age: bool = False,
) -> DataFrame:
    """Targets by indicator, one column per agency; listed agencies first, others follow.

    ``clean`` merges the spellings of an agency's name; without it each has its own column.
    """
    rows = _selected(df, year, indicators)
    if clean:
        rows = rows.withColumn("funding_agency", clean_agency(F.col("funding_agency")))
    rows, ids = _with_age(rows, ["fiscal_year", "indicator"], by_age)
    wide = pivot_sum(rows, ids, "funding_agency", "targets", agencies)
    return custom_order(wide, "indicator", levels)
