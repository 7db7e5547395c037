"""Sums that are kept by fiscal year and brought up to date year by year.

A snapshot restates some years. Their sums are computed again and replace the folders of those years;
other years' folders are not touched, and reading all years reads sums, not rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.operators.aggregate import sum_across
from quarterline.session import stage

YEAR = "fiscal_year"
_MARKS = "_marks"


def year_marks(df: DataFrame) -> DataFrame:
    """(fiscal_year, rows, mark): equal for equal rows in any order, so that a restated year is recognised."""
    whole = F.xxhash64(*sorted(df.columns))

    def mixed(hashed: Column) -> Column:
        # decimals are added: a sum of 48-bit numbers leaves a bigint after some 65,000 rows
        return F.sum(F.shiftrightunsigned(hashed, 16).cast("decimal(20,0)")).cast("decimal(38,0)")

    # two sums over differently mixed halves tell repeated rows and exchanged pairs apart
    return df.groupBy(YEAR).agg(
        F.count("*").alias("rows"), mixed(whole).alias("low"), mixed(F.xxhash64(whole, F.lit(1))).alias("high"))


def changed_years(df: DataFrame, store: str) -> list[int | None]:
    """Years of ``df`` whose rows differ from those the store was last updated with; a number per year reaches the driver."""
    marks = year_marks(df)
    if _exists(df.sparkSession, f"{store}/{_MARKS}"):
        kept = df.sparkSession.read.schema(marks.schema).parquet(f"{store}/{_MARKS}")
        same = [marks[name].eqNullSafe(kept[name]) for name in marks.columns]
        marks = marks.join(kept, same, "left_anti")
    return _ordered(row[YEAR] for row in marks.select(YEAR).collect())


def update_sums(
    df: DataFrame, store: str, keys: Sequence[str], pattern: str, years: Sequence[int | None] | None = None
) -> list[int | None]:
    """Replace the sums of ``years`` of ``df`` in the store; the years.

    Without ``years``, those whose rows have changed. ``keys`` are columns beside the fiscal year; rows without a year
    (NULL) are kept as one more year. ``pattern`` and NULL handling are those of ``sum_across``. Spark writes all new
    folders aside and exchanges them when the job ends, so a lost executor or a failed job leaves the store as it was.
    Marks are written last: a run that stops before them does the same years again.
    """
    years = changed_years(df, store) if years is None else _ordered(set(years))
    if not years:
        return []
    part = df.filter(_of_years(years))
    sums = sum_across(part, [YEAR, *keys], pattern)
    for rows, path in ((sums, f"{store}/sums"), (year_marks(part), f"{store}/{_MARKS}")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(YEAR).parquet(path)
    return years


def kept_sums(spark: SparkSession, store: str) -> DataFrame:
    """All sums of a store; filters on the fiscal year prune folders."""
    # folder names alone give no type to a store that has only rows without a year
    return spark.read.parquet(f"{store}/sums").withColumn(YEAR, F.col(YEAR).cast("int"))


def kept_grouping_sets(spark: SparkSession, store: str, detail: str, keys: Sequence[str], pattern: str) -> DataFrame:
    """Sums by year, ``keys`` and ``detail``, and by year and ``keys`` alone (``detail`` is NULL), from kept sums only."""
    fine = stage(sum_across(kept_sums(spark, store), [YEAR, *keys, detail], pattern))
    coarse = sum_across(fine, [YEAR, *keys], pattern).withColumn(detail, F.lit(None).cast(fine.schema[detail].dataType))
    return fine.unionByName(coarse)


def _ordered(years: Iterable[int | None]) -> list[int | None]:
    return sorted(years, key=lambda year: (year is None, year or 0))


def _of_years(years: Sequence[int | None]) -> Column:
    known = F.col(YEAR).isin(*[year for year in years if year is not None])
    return known | F.col(YEAR).isNull() if None in years else known


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
