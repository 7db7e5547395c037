"""Grouped sums, two-grain sums, category ranking, snapshot metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarterline.functions.labels import period_key, period_label
from quarterline.functions.predicates import matching_columns
from quarterline.schemas import QUARTERS, Metadata


def total(column: Column | str) -> Column:
    """Sum in which a group of NULLs gives 0."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def sum_across(df: DataFrame, keys: Sequence[str | Column], pattern: str) -> DataFrame:
    """NULL-safe sum of every column whose name matches ``pattern``, by ``keys``.

    Map-side partial sums mean a hot key costs one row per task in the shuffle.
    """
    return df.groupBy(*keys).agg(
        *[total(name).alias(name) for name in matching_columns(df, pattern)]
    )


def sum_two_grains(
    df: DataFrame, keys: Sequence[str], detail: str, pattern: str, all_label: str = "Total"
) -> DataFrame:
    """Sums by ``keys`` and by ``keys`` + ``detail`` in one pass over the data.

    Rows of the coarse grain carry ``all_label`` in ``detail`` and ``is_total`` = 1. The
    data is summed to the fine grain first; only those sums are doubled for the two grains.
    """
    names = matching_columns(df, pattern)
    grouped = sum_across(df, [*keys, detail], pattern).groupingSets(
        [list(keys), [*keys, detail]], *keys, detail
    ).agg(
        F.grouping(detail).cast("int").alias("is_total"),
        *[total(name).alias(name) for name in names],
    )
    named = F.when(F.col("is_total") == 1, F.lit(all_label)).otherwise(F.col(detail))
    return grouped.select(*keys, named.alias(detail), "is_total", *names)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def exact_median(df: DataFrame, category: str, value: str) -> DataFrame:
    """Exact median of ``value`` per category without gathering a category in one task.

    Two rounds of counting narrow the values down: bins of equal ratio over all values,
    then 4096 equal bins over what is left. Both are plain counts with map-side partial
    sums. Only the distinct values of the last bin are put in order and read by rank.
    ``category`` must be a label set of known small size, such as a rule list.
    """
    v = F.col("_v")
    rows = df.select(F.col(category).alias("_c"), F.col(value).alias("_v")).filter(v.isNotNull())
    by_ratio = F.floor(F.signum(v) * F.log1p(F.abs(v)) * 2048)
    ratio_bin = _middle_bin(rows.withColumns({"_n": F.lit(None).cast("bigint"), "_below": F.lit(0)}), by_ratio)
    span = F.col("_high") - F.col("_low")
    evenly = F.coalesce(F.floor(F.try_divide(v - F.col("_low"), span) * 4096), F.lit(0))
    even_bin = _middle_bin(_inside(rows, ratio_bin), evenly)
    values = (
        _inside(rows, even_bin).groupBy("_c", "_n", "_below", "_v").agg(F.count("*").alias("_rows"))
        .withColumn("_upto", F.col("_below") + F.sum("_rows").over(_upward("_v")))
    )
    lower, upper = [F.min(F.when(F.col("_upto") >= rank, v)) for rank in _middle_ranks()]
    return values.groupBy("_c").agg(((lower + upper) / 2).alias("median")).select(
        F.col("_c").alias(category), "median"
    )


def _middle_ranks() -> tuple[Column, Column]:
    n = F.col("_n")
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def _upward(order: str) -> WindowSpec:
    return (
        Window.partitionBy("_c").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _middle_bin(rows: DataFrame, bin: Column) -> DataFrame:
    """Per category the value range of the bins that hold its middle ranks.

    ``bin`` must not fall where the value rises. ``_below`` counts the smaller rows.
    """
    lower, upper = _middle_ranks()
    counted = F.coalesce(F.col("_n"), F.sum("_rows").over(Window.partitionBy("_c")))
    return (
        rows.groupBy("_c", "_n", "_below", bin.alias("_bin"))
        .agg(F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_upto", F.col("_below") + F.sum("_rows").over(_upward("_bin")))
        .withColumn("_n", counted)
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .filter((F.col("_upto") >= lower) & (F.col("_before") < upper))
        .groupBy("_c", "_n")
        .agg(
            F.min("_before").alias("_below"), F.min("_low").alias("_low"),
            F.max("_high").alias("_high"),
        )
    )


def _inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows within the range of their category; ``ranges`` has one row per category."""
    one = ranges.withColumnRenamed("_c", "_category")
    return rows.join(one, F.col("_c").eqNullSafe(F.col("_category"))).filter(
        F.col("_v").between(F.col("_low"), F.col("_high"))
    )


def category_order(df: DataFrame, category: str, value: str) -> DataFrame:
    """Rank of each category by descending median, ties by label: ``(category, median, mod_order)``."""
    by_median = Window.orderBy(F.col("median").desc(), F.col(category))
    return exact_median(df, category, value).withColumn(
        "mod_order", F.row_number().over(by_median)
    )


def latest_period(df: DataFrame, quarters: Sequence[str] = QUARTERS) -> DataFrame:
    """One row ``(curr_fy, curr_qtr)``: the last quarter with any non-NULL value."""
    last = F.coalesce(
        *[F.when(F.col(name).isNotNull(), F.lit(i)) for i, name in reversed(list(enumerate(quarters, 1)))]
    )
    return df.agg(
        F.max(F.when(last.isNotNull(), F.struct(F.col("fiscal_year"), last.alias("q")))).alias("p")
    ).select(F.col("p.fiscal_year").alias("curr_fy"), F.col("p.q").alias("curr_qtr"))


def snapshot_metadata(df: DataFrame, source: str) -> DataFrame:
    """Current year, quarter, period, its sort key, source and caption of a snapshot."""
    fy, quarter = F.col("curr_fy"), F.col("curr_qtr")
    return latest_period(df).select(
        "curr_fy", "curr_qtr",
        period_label(fy, quarter).alias("curr_pd"),
        period_key(fy, quarter).alias("curr_key"),
        F.lit(source).alias("source"),
        F.concat(F.lit("Source: "), F.lit(source)).alias("caption"),
    )


def read_metadata(df: DataFrame, source: str) -> Metadata:
    """The same as a record on the driver (one row), for use as literals."""
    row = latest_period(df).first()
    if row is None or row["curr_fy"] is None:
        raise ValueError("the snapshot holds no quarterly value")
    return Metadata(row["curr_fy"], row["curr_qtr"], source)
