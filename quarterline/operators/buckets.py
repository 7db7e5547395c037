"""Mechanism tables kept in buckets, so that reports join them without moving rows.

Both sides of a name join are written once in buckets of one key; every later join of the two is a merge of
bucket with bucket. The fact side holds sums, a few rows per mechanism and year: a mechanism with a third of all
fact rows has no more of them than others, and no bucket grows with its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.session import shuffle_partitions, stage_bucketed

KEY = "_bucket_key"


def bucket_key(columns: Sequence[str]) -> Column:
    """One text per combination of values, NULL being a value of its own; equal for equal combinations only."""
    return F.to_json(F.struct(*[F.col(name).cast("string").alias(name) for name in columns]))


def in_buckets(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` with its key, rows of one key in one bucket and sorted there.

    ``buckets``  by default one per shuffle partition; two tables meet without a shuffle if they have equally many.
    """
    count = buckets or shuffle_partitions(df.sparkSession)
    # placed first, every task writes one file; otherwise each would write one per bucket
    placed = df.withColumn(KEY, bucket_key(columns)).repartition(count, KEY)
    return stage_bucketed(placed, count, KEY, [KEY])


def join_buckets(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join of two tables made by ``in_buckets`` over the same columns; NULL matches NULL.

    The columns of ``left``, then those of ``right`` that it lacks. A merge, never a broadcast, so that neither side's size matters.
    """
    added = [name for name in right.columns if name not in left.columns]
    joined = left.hint("merge").join(right.select(KEY, *added), KEY, how)
    return joined.select(*[name for name in left.columns if name != KEY], *added)


def short_names(sums: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """``fix_mech_names`` on bucketed tables: the crosswalk's short name replaces ``mech_name`` where it has one."""
    joined = join_buckets(sums, crosswalk)
    name = F.coalesce("mech_name_short", "mech_name").alias("mech_name")
    return joined.select(*[name if column == "mech_name" else column for column in joined.columns])
