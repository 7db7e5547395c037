"""Append tables, compare columns, attach names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.predicates import null_safe_equal


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Append by column name; a column a table lacks is NULL there. Keeps duplicates."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def compare_columns(x: DataFrame, y: DataFrame) -> DataFrame:
    """Distinct values of a one-column table that the other lacks, both ways, in one row.

    One grouped pass over both sides; NULL counts as a value.
    """
    def side(df: DataFrame, is_x: bool) -> DataFrame:
        return df.toDF("value").select("value", F.lit(is_x).alias("in_x"))

    values = side(x, True).union(side(y, False)).groupBy("value").agg(
        F.bool_or("in_x").alias("in_x"), F.bool_or(~F.col("in_x")).alias("in_y")
    )
    counts = values.agg(
        F.count_if(~F.col("in_y")).alias("n_x_not_y"),
        F.count_if(~F.col("in_x")).alias("n_y_not_x"),
    )
    n_x, n_y = F.col("n_x_not_y"), F.col("n_y_not_x")
    message: Column = F.when(
        (n_x == 0) & (n_y == 0), F.lit("both hold the same values")
    ).otherwise(
        F.concat(
            F.lit("only in x: "), n_x.cast("string"), F.lit(", only in y: "), n_y.cast("string"),
        )
    )
    return counts.withColumn("message", message)


def fix_mech_names(df: DataFrame, crosswalk: DataFrame, check_keys: bool = False) -> DataFrame:
    """Use the crosswalk's short mechanism name where it has one.

    Both keys match NULL to NULL, and a key listed twice doubles its rows;
    ``check_keys`` raises on such a key instead. Spark broadcasts the crosswalk when
    its size allows and otherwise splits hot mechanisms in the sort-merge join.
    """
    keys = ["mech_code", "mech_name"]
    if check_keys:
        names = crosswalk.groupBy(*keys).agg(
            F.count("*").alias("_n"), F.first("mech_name_short").alias("mech_name_short")
        )
        once = F.assert_true(F.col("_n") == 1, F.lit("crosswalk lists a mechanism twice"))
        crosswalk = names.filter(once.isNull()).drop("_n")
    joined = df.join(crosswalk, null_safe_equal(df, crosswalk, keys), "left")
    short = crosswalk["mech_name_short"]
    return joined.select(
        *[
            F.coalesce(short, df[name]).alias(name) if name == "mech_name" else df[name]
            for name in df.columns if name != "mech_name_short"
        ],
        short,
    )


def map_mech_names(df: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """Attach agency, partner and mechanism name by mechanism code; unknown codes stay.

    Names that ``df`` has already give way to those of the mechanism list.
    """
    given = [name for name in mechanisms.columns if name != "mech_code"]
    return df.drop(*given).join(mechanisms, "mech_code", "left")
