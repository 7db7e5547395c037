"""Results against targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterline.functions.classify import Bands, achievement_band
from quarterline.functions.labels import comma_label, format_achievement, percent_label
from quarterline.functions.predicates import ratio
from quarterline.operators.aggregate import sum_two_grains
from quarterline.operators.reshape import reshape_quarters
from quarterline.schemas import Metadata


def add_ratio(df: DataFrame) -> DataFrame:
    """``achv`` = results / targets."""
    return df.withColumn("achv", ratio(F.col("results"), F.col("targets")))


def calc_achievement(df: DataFrame) -> DataFrame:
    """``achievement`` = cumulative / targets."""
    return df.withColumn("achievement", ratio(F.col("cumulative"), F.col("targets")))


def adorn_achievement(df: DataFrame, quarter: int, bands: Bands = Bands()) -> DataFrame:
    """Band of the achievement for the quarter reached."""
    return df.withColumn("band", achievement_band(F.col("achievement"), quarter, bands))


def add_achievement_label(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "tgt_rslt_sum", format_achievement(F.col("cumulative"), F.col("targets"))
    )


def add_chart_labels(df: DataFrame) -> DataFrame:
    """The three texts a results/targets figure prints."""
    return df.withColumns({
        "achv_label": percent_label(F.col("achv")),
        "results_label": comma_label(F.col("results")),
        "targets_label": comma_label(F.col("targets")),
    })


def brief(
    df: DataFrame, keys: Sequence[str], metadata: Metadata, detail: str = "funding_agency"
) -> DataFrame:
    """Current quarter per ``keys``, for each ``detail`` and all of them together.

    Gives results, running results, target, achievement of the running results, and
    the change against the quarter just before (NULL when that quarter has no row).
    The quarter value is compared, not the running one, which restarts each year.
    """
    sums = sum_two_grains(df, ["fiscal_year", *keys], detail, r"^(qtr[1-4]|targets)$")
    series = reshape_quarters(sums)
    before = Window.partitionBy(*keys, detail, "is_total").orderBy("period_key")
    follows = F.lag("period_key").over(before) == F.col("period_key") - 1
    change = F.col("results") - F.col("prior_results")
    return (
        series.filter(F.col("period_key").between(metadata.curr_key - 1, metadata.curr_key))
        .withColumn("prior_results", F.when(follows, F.lag("results").over(before)))
        .filter(F.col("period_key") == metadata.curr_key)
        .withColumns({
            "achievement": ratio(F.col("results_cumulative"), F.col("targets")),
            "change": change,
            "change_share": ratio(change, F.col("prior_results")),
            "direction": F.when(change > 0, F.lit("up"))
            .when(change < 0, F.lit("down"))
            .when(change == 0, F.lit("same")),
            "caption": F.lit(f"{metadata.caption} | {metadata.curr_pd}"),
        })
        .drop("period_key")
    )
