"""Verbs for which row order carries meaning. The order is always an explicit column.

What earlier rows amount to is a prefix scan: rows are sorted once into ranges of (group, order), each range is
worked off by one task, and what the ranges before say about a group enters each range as one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterline.session import shuffle_partitions, stage_bucketed


def fill_up(df: DataFrame, column: str, group: Sequence[str], order: str) -> DataFrame:
    """Replace NULL by the next later non-NULL value of the group.

    For period series: a group has one row per period.
    """
    # from the last row backwards: a running frame, where one that looks ahead restarts per row
    backwards = (
        Window.partitionBy(*group).orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(column, F.last(column, ignorenulls=True).over(backwards))


def fill_down(
    df: DataFrame,
    column: str,
    order: Sequence[str],
    group: Sequence[str] = (),
    few: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Replace NULL by the last earlier non-NULL value, within ``group`` or over all rows.

    ``order``  columns, most significant first, that number the rows of a group uniquely.
    ``few``    not needed: order columns with few values are treated like any other.
    ``blocks`` ranges of rows to cut into, by default one per shuffle partition and at most ``MOST_RANGES``
               times as many.

    See ``_before`` for how a long group is spread over tasks.
    """
    out = _before(df, column, group, order, "last", blocks)
    return out.withColumn(column, F.coalesce(F.col(column), F.col("_before"))).select(*df.columns)


def row_index(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    few: Sequence[str] = (),
    name: str = "row_index",
    blocks: int | None = None,
) -> DataFrame:
    """Number the rows of a group, or of the table, from 0 in the given order."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = _before(counted, "_one", group, order, "sum", blocks)
    return out.select(*df.columns, F.coalesce(F.col("_before"), F.lit(0)).alias(name))


def every_nth(
    df: DataFrame,
    n: int,
    order: Sequence[str],
    group: Sequence[str] = (),
    few: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Every n-th row in the given order, starting with the first."""
    indexed = row_index(df, order, group, few, "_index", blocks)
    return indexed.filter(F.col("_index") % n == 0).drop("_index")


def previous_value(
    df: DataFrame, column: str, order: Sequence[str], few: Sequence[str] = (), name: str = "previous",
    blocks: int | None = None,
) -> DataFrame:
    """Add the last non-NULL value of ``column`` before each row in the order of the whole table."""
    out = _before(df, column, (), order, "last", blocks)
    return out.select(*df.columns, F.col("_before").alias(name))


#: ranges per shuffle partition, beyond which more of them would only make smaller tasks
MOST_RANGES = 4


def _before(
    df: DataFrame, column: str, group: Sequence[str], order: Sequence[str], how: str, blocks: int | None
) -> DataFrame:
    """Add ``_before``: what the rows before this one in the group amount to.

    ``how`` is ``last`` (their last non-NULL value) or ``sum``. Rows are sorted into ranges of (group, order) by
    Spark's range partitioning, whose borders come from a sample of the rows and stay with the executors: no border is
    part of a plan. The ranges are staged as buckets, so that this one shuffle serves the scan inside
    them too. Groups follow each other, so only a range's last group can go on in later ranges: one row per range,
    with that group and what it amounts to there, is all that is put in order over the whole table and sent back.
    """
    most = shuffle_partitions(df.sparkSession)
    ranges = max(1, min(blocks or most, MOST_RANGES * most))
    # plain names: a staged table takes any column name then
    names = {name: f"_c{i}" for i, name in enumerate(df.columns)}
    value, by, keys = names[column], [names[name] for name in order], [names[name] for name in group]
    rows = stage_bucketed(
        df.toDF(*names.values()).repartitionByRange(ranges, *keys, *by).withColumn("_range", F.spark_partition_id()),
        ranges, "_range", [*keys, *by])
    # one field even without a group, so that it can be compared
    rows = rows.withColumn("_group", F.struct(F.lit(0).alias("_"), *keys))
    if how == "last":
        summary = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*by)))
        so_far = lambda name: F.last(name, ignorenulls=True)
    else:
        summary, so_far = F.sum(value), F.sum
    ends = rows.groupBy("_range", "_group").agg(summary.alias("_sum")).groupBy("_range").agg(
        F.min("_group").alias("_first"), F.max("_group").alias("_last"), F.max_by("_sum", "_group").alias("_sum"))
    upto = Window.partitionBy("_last").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ends.withColumn("_sum", so_far("_sum").over(upto)).withColumn(
        "_left", F.lag(F.struct("_last", "_sum")).over(Window.orderBy("_range")))
    opening = running.filter(F.col("_left._last") == F.col("_first")).select(
        F.col("_range").alias("_at"), F.col("_first").alias("_goes_on"), F.col("_left._sum").alias("_opening"))
    # a row per range at most
    placed = rows.join(F.broadcast(opening), (F.col("_range") == F.col("_at")) & (F.col("_group") == F.col("_goes_on")), "left")
    earlier = Window.partitionBy("_range", "_group").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = so_far(value).over(earlier)
    if how == "last":
        before = F.coalesce(inside, F.col("_opening"))
    else:
        before = F.coalesce(inside + F.col("_opening"), inside, F.col("_opening"))
    found = placed.withColumn("_before", before)
    return found.select(*[F.col(new).alias(name) for name, new in names.items()], "_before")
