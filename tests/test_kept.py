"""Tables that are kept: sketches, sums by year, buckets, wide grids, checked reads, SQL functions."""

import random

import pytest
from pyspark.sql import functions as F

from quarterline.functions import labels
from quarterline.functions.sql import register_sql_functions
from quarterline.operators.aggregate import exact_median, sum_across
from quarterline.operators.buckets import in_buckets, join_buckets, short_names
from quarterline.operators.combine import fix_mech_names
from quarterline.operators.grid import CHUNK, complete_grid, complete_wide
from quarterline.operators.sketches import (
    K, merge_sketches, rank_error, sketched_medians, sketched_order, value_sketches,
)
from quarterline.operators.summaries import changed_years, kept_grouping_sets, kept_sums, update_sums
from quarterline.schemas import INDICATOR_RESULTS
from quarterline.sources.snapshots import read_checked
from tests.test_plans import plan, settings


# -- sketches -------------------------------------------------------------------


@pytest.mark.parametrize("value", ["cast(id as double)", "exp(rand(3) * 40)", "cast(id % 7 as double)", "-randn(5)"])
def test_sketched_median_is_within_its_rank_error(spark, value):
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'a', if(id % 1000 = 1, 'b', null)) c", "id % 8 AS y", f"{value} v")
    df = spark.createDataFrame(df.collect(), "c STRING, y BIGINT, v DOUBLE").repartition(6)
    stored = spark.createDataFrame(value_sketches(df, ["y", "c"], "v").collect(), "y BIGINT, c STRING, sketch BINARY")
    medians = sketched_medians(merge_sketches(stored, ["c"]), "c")
    ranks = df.alias("d").join(medians.alias("m"), F.expr("d.c <=> m.c")).groupBy("m.c", "m.n").agg(
        (F.count_if(F.col("v") < F.col("median")) / F.col("m.n")).alias("below"), (F.count_if(F.col("v") <= F.col("median")) / F.col("m.n")).alias("upto"))
    rows = ranks.collect()
    assert {r["c"]: r["n"] for r in rows} == {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    # three times the bound of 99 % of cases
    assert all(r["below"] - 3 * rank_error() <= 0.5 <= r["upto"] + 3 * rank_error() for r in rows)


def test_a_sketch_of_few_values_is_exact(spark):
    random.seed(1)
    data = [(f"m{c}", c % 3, random.uniform(-5, 5)) for c in range(300) for _ in range(2 * random.randint(0, 40) + 1)]
    df = spark.createDataFrame([*data, ("empty", 1, None)], "c STRING, y INT, v DOUBLE")
    merged = merge_sketches(value_sketches(df, ["c", "y"], "v"), ["c"])
    expected = {r["c"]: r["median"] for r in exact_median(df, "c", "v").collect()}
    assert {r["c"]: r["median"] for r in sketched_medians(merged, "c").collect()} == expected
    top = sketched_order(merged, "c", top=10).collect()
    assert [r["c"] for r in sorted(top, key=lambda r: r["mod_order"])] == sorted(expected, key=lambda c: (-expected[c], c))[:10]
    assert 0.01 < rank_error(K) < 0.02


# -- sums by year -----------------------------------------------------------------

SUMS = "fiscal_year INT, indicator STRING, agency STRING, qtr1 DOUBLE, targets DOUBLE"


def _facts(spark, *changed):
    random.seed(2)
    rows = [(y, f"i{k % 4}", f"a{k % 3}" if k % 11 else None, float(random.randint(0, 99)), None if k % 5 else 2.0) for y in range(2020, 2024) for k in range(60)]
    return spark.createDataFrame([*rows, *changed], SUMS)


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.glob("sums/*/*.parquet")}


def test_updating_one_year_rewrites_one_folder(spark, tmp_path, rows):
    store, keys = str(tmp_path / "s"), ["indicator", "agency"]
    assert update_sums(_facts(spark), store, keys, "qtr|targets") == [2020, 2021, 2022, 2023]
    before = _files(tmp_path / "s")
    newer = _facts(spark, (2022, "i9", "a1", 7.0, 1.0))
    assert changed_years(newer, store) == [2022]
    assert update_sums(newer, store, keys, "qtr|targets") == [2022]
    after = _files(tmp_path / "s")
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if "fiscal_year=2022" in f}
    full = sum_across(newer, ["fiscal_year", *keys], "qtr|targets")
    assert rows(kept_sums(spark, store), *full.columns) == rows(full)
    assert update_sums(newer, store, keys, "qtr|targets") == []
    assert "fiscal_year" in plan(kept_sums(spark, store).filter("fiscal_year = 2021")).split("PartitionFilters")[1][:60]


def test_named_years_and_new_years(spark, tmp_path, rows):
    store = str(tmp_path / "s")
    update_sums(_facts(spark).filter("fiscal_year < 2022"), store, ["indicator"], "qtr")
    df = _facts(spark, (2024, "i1", "a1", 1.0, 1.0))
    assert update_sums(df, store, ["indicator"], "qtr", years=[2023]) == [2023]
    assert update_sums(df, store, ["indicator"], "qtr") == [2022, 2024]
    assert rows(kept_sums(spark, store), "fiscal_year", "indicator", "qtr1") == rows(sum_across(df, ["fiscal_year", "indicator"], "qtr"))


def test_marks_tell_exchanged_and_repeated_rows_apart(spark, tmp_path):
    store = str(tmp_path / "s")
    one = spark.createDataFrame([(2020, "a", "x", 1.0, 2.0), (2020, "b", "x", 2.0, 1.0)], SUMS)
    update_sums(one, store, ["indicator"], "qtr")
    assert changed_years(one.orderBy(F.desc("indicator")), store) == []
    assert changed_years(one.unionAll(one), store) == [2020]
    assert changed_years(spark.createDataFrame([(2020, "a", "x", 2.0, 2.0), (2020, "b", "x", 1.0, 1.0)], SUMS), store) == [2020]


def test_marks_hold_for_years_of_many_rows(spark, tmp_path, rows):
    """Hash sums of so many rows leave a bigint."""
    store = str(tmp_path / "s")
    df = spark.range(300_000).selectExpr("cast(2020 + id % 2 as int) fiscal_year", "concat('i', id % 5) indicator", "cast(id as double) qtr1")
    assert update_sums(df, store, ["indicator"], "qtr") == [2020, 2021]
    assert changed_years(df.repartition(3), store) == []
    newer = df.withColumn("qtr1", F.expr("if(qtr1 = 299999, 0, qtr1)"))
    assert update_sums(newer, store, ["indicator"], "qtr") == [2021]
    assert rows(kept_sums(spark, store), "fiscal_year", "indicator", "qtr1") == rows(sum_across(newer, ["fiscal_year", "indicator"], "qtr"))


def test_rows_without_a_year_are_kept(spark, tmp_path, rows):
    store, keys = str(tmp_path / "s"), ["indicator", "agency"]
    df = _facts(spark, (None, "i1", "a1", 3.0, 1.0), (None, "i1", "a1", 4.0, None))
    assert update_sums(df, store, keys, "qtr|targets") == [2020, 2021, 2022, 2023, None]
    assert changed_years(df, store) == []
    newer = _facts(spark, (None, "i1", "a1", 5.0, 1.0), (2024, None, "a1", 1.0, 1.0))
    assert changed_years(newer, store) == [2024, None]
    assert update_sums(newer, store, keys, "qtr|targets", years=[None, 2024, None]) == [2024, None]
    full = sum_across(newer, ["fiscal_year", *keys], "qtr|targets")
    assert rows(kept_sums(spark, store), *full.columns) == rows(full)
    update_sums(newer.filter("fiscal_year IS NULL"), f"{store}0", keys, "qtr|targets")
    assert kept_sums(spark, f"{store}0").schema["fiscal_year"].dataType == full.schema["fiscal_year"].dataType


def test_grouping_sets_from_kept_sums(spark, tmp_path, rows):
    store = str(tmp_path / "s")
    df = _facts(spark).filter("agency IS NOT NULL")
    update_sums(df, store, ["indicator", "agency"], "qtr|targets")
    got = kept_grouping_sets(spark, store, "agency", ["indicator"], "qtr|targets")
    fine, coarse = (sum_across(df, ["fiscal_year", "indicator", *more], "qtr|targets") for more in (["agency"], []))
    assert rows(got.filter("agency IS NULL"), *coarse.columns) == rows(coarse)
    assert rows(got.filter("agency IS NOT NULL"), *fine.columns) == rows(fine)


# -- buckets ----------------------------------------------------------------------

CODES = "mech_code STRING, mech_name STRING"


def test_bucketed_names_equal_the_join_and_move_nothing(spark, rows):
    names = [("1", "one", "S1"), ("2", "two", None), (None, "nobody", "SN"), ("3", None, "S3"), ("", "blank", "SB"), ("1", "uno", "SU")]
    facts = [(code, name, float(k)) for k, (code, name, _) in enumerate(names * 3)] + [("9", "nine", 9.0), (None, None, 1.0), ("", "nobody", 2.0)]
    df, cw = spark.createDataFrame(facts, CODES + ", v DOUBLE"), spark.createDataFrame(names, CODES + ", mech_name_short STRING")
    by = ["mech_code", "mech_name"]
    left, right = in_buckets(df, by, 4), in_buckets(cw, by, 4)
    found = short_names(left, right)
    text = plan(found)
    assert "Exchange" not in text and "SortMergeJoin" in text and text.count("Bucketed: true") == 2
    assert rows(found, "mech_code", "v", "mech_name", "mech_name_short") == rows(fix_mech_names(df, cw), "mech_code", "v", "mech_name", "mech_name_short")
    assert found.columns == [*df.columns, "mech_name_short"]


def test_other_bucket_counts_and_inner_joins(spark, rows):
    df = spark.range(100).selectExpr("cast(id % 10 as string) mech_code", "id")
    other = spark.range(5).selectExpr("cast(id as string) mech_code", "id * 2 AS twice")
    joined = join_buckets(in_buckets(df, ["mech_code"], 4), in_buckets(other, ["mech_code"], 8), "inner")
    assert joined.count() == 50 and joined.columns == ["mech_code", "id", "twice"]


# -- wide grids -------------------------------------------------------------------


@pytest.mark.parametrize("values", [1, 7, 3 * CHUNK])
def test_wide_grid_equals_the_grid(spark, rows, values):
    random.seed(values)
    cells = random.sample([(f"k{k}" if k else None, f"v{v}" if v else None) for k in range(4) for v in range(values)], min(2 * values, 300))
    df = spark.createDataFrame([(k, v, float(i), i) for i, (k, v) in enumerate(cells)], "k STRING, v STRING, x DOUBLE, n INT")
    wide = complete_wide(df, ["k"], "v")
    assert wide.columns == df.columns and rows(wide) == rows(complete_grid(df, ["k"], ["v"]))
    filled = complete_wide(df, ["k"], "v", {"x": 0.0})
    assert filled.filter("x IS NULL").count() == 0 and filled.filter("n IS NULL").count() == wide.count() - len(cells)


def test_wide_grid_refuses_duplicates_and_takes_no_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "k STRING, v STRING, x DOUBLE")
    with pytest.raises(Exception, match="(?i)duplicate"):
        complete_wide(df, ["k"], "v").collect()
    assert complete_wide(df.limit(0), ["k"], "v").collect() == []


def test_a_million_values_are_spread(spark):
    df = spark.range(1_000_000).selectExpr("cast(id % 3 as int) k", "id AS v", "1 AS x")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="16"):
        wide = complete_wide(df, ["k"], "v")
        sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3_000_000 and max(sizes) < 0.2 * sum(sizes)
        assert wide.filter("x = 1").count() == 1_000_000
        text = plan(wide)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


# -- checked reads ----------------------------------------------------------------


def test_lines_that_do_not_fit_are_rejected_whole(spark, tmp_path):
    header = "\t".join(INDICATOR_RESULTS.fieldNames())
    good = "2023\tI\tD\tM\tA\t1\tone\t1.5\tNA\t0\t2\tNA\t3"
    bad = [good.replace("1.5", "many"), good.replace("2023", "FY23"), good.rsplit("\t", 1)[0], good + "\tmore"]
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "one.txt").write_text("\n".join([header, good, bad[0], good, bad[2]]) + "\n")
    (folder / "two.txt").write_text("\n".join([header, bad[1], bad[3]]) + "\n")
    accepted, rejected = read_checked(spark, str(folder))
    assert accepted.count() == 2 and accepted.schema == INDICATOR_RESULTS
    assert {r["qtr2"] for r in accepted.select("qtr2").collect()} == {None}
    assert sorted(map(tuple, rejected.collect())) == sorted(
        [("one.txt", bad[0]), ("one.txt", bad[2]), ("two.txt", bad[1]), ("two.txt", bad[3])])
    # which lines are bad does not depend on the columns that are read
    assert accepted.select("indicator").count() == 2 and rejected.count() == 4


# -- SQL functions ----------------------------------------------------------------

NUMBERS = [None, 0.0, -0.0, 1.0, 999.5, 2500.0, 3500.0, 999_500.0, 1e6, -5e6, 1.25e9, 7e12, 0.1 + 0.2, 1e-9, 123.456, 5e20]


def test_sql_functions_equal_the_columns(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(a, b) for a in NUMBERS for b in (None, 2e4)], "a DOUBLE, b DOUBLE")
    pairs = {
        "clean_number(a)": labels.clean_number(F.col("a")), "short_number(a)": labels.short_number(F.col("a")),
        "format_achievement(a, b)": labels.format_achievement(F.col("a"), F.col("b")),
    }
    for text, column in pairs.items():
        for row in df.select("a", F.expr(text).alias("x"), column.alias("y")).collect():
            assert row["x"] == row["y"], (text, row)
    texts = spark.createDataFrame([("a b c d",), ("a  b",), ("one",), ("",), (None,), ("Y015_999",), ("Y0Y0_0_0",), ("Y020_024",)], "t STRING")
    for text, column in {"words(t, 1, 3)": labels.words(F.col("t"), 1, 3), "words(t, 2, 2)": labels.words(F.col("t"), 2, 2),
                         "age_label(t)": labels.age_label(F.col("t"))}.items():
        assert texts.filter(~F.expr(text).eqNullSafe(column)).count() == 0, text


def test_sql_functions_are_put_in_place(spark):
    register_sql_functions(spark)
    df = spark.sql("SELECT clean_number(cast(id AS double)) AS n, age_label('Y015_019') AS a FROM range(5)")
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "clean_number" not in text and "UDF" not in text and "15-19" in text
