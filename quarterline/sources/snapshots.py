"""Find, read, describe and write indicator snapshots."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.schemas import INDICATOR_RESULTS, QUARTERS, TARGETS


def list_snapshots(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Entries of ``folder`` whose name matches: ``(name, path, modified)``.

    Only file listings are read, never content. A folder of part files counts as one
    entry, as new as its newest part.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "modificationTime")
    )
    plain = folder.rstrip("/")
    if ":/" not in plain and not plain.startswith("/"):
        plain = os.path.abspath(plain)
    root = r"^.*?\Q" + re.sub(r"^\w+:/+", "/", plain) + r"\E/([^/]+)"
    return (
        files.select(
            F.regexp_extract("path", root, 1).alias("name"),
            F.regexp_extract("path", root, 0).alias("path"),
            "modificationTime",
        )
        .filter(F.col("name").rlike(pattern))
        .groupBy("name", "path")
        .agg(F.max("modificationTime").alias("modified"))
    )


def latest_snapshot(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the newest matching entry; among equals the greatest path."""
    best = list_snapshots(spark, folder, pattern).agg(
        F.max(F.struct("modified", "path")).alias("best")
    ).first()["best"]
    if best is None:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern!r}")
    return best["path"]


def _read(spark: SparkSession, path: str, schema: T.StructType, form: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if form == "parquet":
        return reader.parquet(path)
    separator = "\t" if form == "tsv" else ","
    return reader.csv(path, sep=separator, header=True, nullValue="NA", enforceSchema=False)


def read_indicators(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """An indicator snapshot (``parquet``, ``tsv`` or ``csv``) with its fixed schema."""
    return _read(spark, path, INDICATOR_RESULTS, form)


#: where the text of a line is kept that does not fit the schema
_BAD = "_rejected_line"


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType = INDICATOR_RESULTS, form: str = "tsv"
) -> tuple[DataFrame, DataFrame]:
    """Rows of a delimited snapshot that fit the schema, and the lines that do not: ``(accepted, rejected)``.

    A line with too few or too many fields, or with a text where a number belongs, is rejected as a whole, with its
    ``file`` and ``line``. Both come from one kind of scan and no line is in neither. All columns
    are parsed for both, whatever is selected later: what is rejected does not depend on the columns a report reads.
    """
    kept = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(kept).csv(
        path, sep="\t" if form == "tsv" else ",", header=True, nullValue="NA", mode="PERMISSIVE",
        columnNameOfCorruptRecord=_BAD, enforceSchema=False)
    # only columns that are read are parsed: whether a line is bad has to read them all
    other = F.when(F.coalesce(*[F.col(name).cast("string") for name in schema.fieldNames()]).isNull(), F.lit(-1)).otherwise(F.lit(-2))
    bad = F.coalesce(F.length(_BAD), other) >= 0
    rejected = rows.filter(bad).select(F.col("_metadata.file_name").alias("file"), F.col(_BAD).alias("line"))
    return rows.filter(~bad).drop(_BAD), rejected


def read_targets(
    spark: SparkSession, path: str, type: str = "ALL", form: str = "parquet"
) -> DataFrame:
    """One type of a landed target table: ``SUBNAT``, ``ALL`` or ``PSNUxIM``."""
    return targets_of_type(_read(spark, path, TARGETS, form), type)


def targets_of_type(targets: DataFrame, type: str) -> DataFrame:
    return targets.filter(F.col("type") == type)


def year_folders(spark: SparkSession, path: str) -> list[int]:
    """Fiscal years that a snapshot landed by ``write_by(df, path, "fiscal_year")`` has folders for, newest first.

    One listing of one folder; empty for a snapshot without year folders.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    entries = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = [re.fullmatch(r"fiscal_year=(\d+)", entry.getPath().getName()) for entry in entries]
    return sorted((int(name[1]) for name in names if name), reverse=True)


def newest_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest year in which a snapshot has a quarterly value; no row if it has none at all.

    Years come from folder names where there are any, newest first, and only folders from that year on are read: targets
    are often set a year or two ahead of results. In a snapshot of plain files one pass over five
    columns finds the year, and row groups of other years are skipped by their statistics.
    """
    df = read_indicators(spark, path)
    year, any_result = F.col("fiscal_year"), F.coalesce(*QUARTERS).isNotNull()
    years = year_folders(spark, path)
    for known in years:
        if not df.filter((year == known) & any_result).isEmpty():
            return df.filter(year == known)
    found = None if years else df.filter(any_result).agg(F.max(year)).first()[0]
    return df.filter(year == F.lit(found).cast("int"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header; NULL as ``NA``. One file per partition of ``df``."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "errorifexists") -> None:
    """One folder per value of ``columns``, all from one job.

    The rebalance gathers a value's rows before the write, so that a value does not
    get a file from every task, and splits a value that is too big for one task.
    """
    df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).parquet(path)


def profile(df: DataFrame, distinct: str | None = "approximate") -> DataFrame:
    """Per column: type, rows, non-NULL rows and distinct values.

    ``distinct``  "approximate" (``approx_distinct``, one pass over the table), "exact" (``n_distinct``: values of
                  each column are made distinct before they are counted) or None.
    """
    kinds = dict(df.dtypes)
    measures = {"rows": lambda c: F.count(F.lit(1)), "non_null": F.count}
    if distinct == "approximate":
        measures["approx_distinct"] = F.approx_count_distinct
    row = df.agg(*[
        F.struct(*[f(F.col(f"`{c}`")).alias(m) for m, f in measures.items()]).alias(f"c{i}")
        for i, c in enumerate(df.columns)
    ])
    entries: Sequence = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"),
            *[F.col(f"c{i}.{m}").alias(m) for m in measures],
        )
        for i, c in enumerate(df.columns)
    ]
    table = row.select(F.inline(F.array(*entries)))
    if distinct != "exact":
        return table
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns
    ])))
    counts = values.filter(F.col("value").isNotNull()).distinct().groupBy("column_name").agg(
        F.count("*").alias("n_distinct"))
    return table.join(counts, "column_name", "left").select(
        *table.columns, F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
