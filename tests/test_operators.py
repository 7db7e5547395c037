import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarterline.operators.achievement import brief
from quarterline.operators.aggregate import (
    category_order, exact_median, read_metadata, sum_across, sum_two_grains,
)
from quarterline.operators.combine import bind_rows, compare_columns, fix_mech_names, map_mech_names
from quarterline.operators.grid import complete_grid, complete_series
from quarterline.operators.ordered import every_nth, fill_down, fill_up, row_index
from quarterline.operators.reshape import custom_order, pivot_sum, reshape_long, reshape_quarters
from quarterline.operators.shares import period_totals, share_of_group, share_of_period, start_end
from quarterline.schemas import Metadata

WIDE = "fiscal_year INT, indicator STRING, qtr1 DOUBLE, qtr2 DOUBLE, qtr3 DOUBLE, qtr4 DOUBLE, targets DOUBLE, cumulative DOUBLE"


def test_sum_of_nulls_is_zero(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 1.0)], "k STRING, qtr1 DOUBLE")
    assert rows(sum_across(df, ["k"], "^qtr")) == [(None, 1.0), ("a", 0.0), ("b", 2.0)]


def test_two_grains_keep_a_real_null_apart_from_the_total(spark, rows):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", None, 2.0)], "k STRING, g STRING, targets DOUBLE")
    assert rows(sum_two_grains(df, ["k"], "g", "targets")) == [
        ("x", None, 0, 2.0), ("x", "Total", 1, 3.0), ("x", "a", 0, 1.0)]


def test_reshape_long_drops_null_keeps_zero(spark, rows):
    df = spark.createDataFrame([(2023, "a", 1.0, 0.0, None, None, 9.0, None)], WIDE)
    assert rows(reshape_long(df), "period", "period_key", "period_type", "value") == [
        ("FY23", 8096, "targets", 9.0), ("FY23Q1", 8093, "results", 1.0), ("FY23Q2", 8094, "results", 0.0)]


def test_long_and_back(spark, rows):
    data = [(2022 + y, k, *[float(y * 10 + q) for q in range(4)], 5.0, 6.0) for y in range(2) for k in "ab"]
    df = spark.createDataFrame(data, WIDE)
    long = reshape_long(df).filter(F.col("period_type") == "results")
    year = ((F.col("period_key") - 1) / 4).cast("int").alias("fiscal_year")
    quarter = F.concat(F.lit("qtr"), F.right("period", F.lit(1))).alias("q")
    back = long.select(year, "indicator", quarter, "value").groupBy("fiscal_year", "indicator").pivot(
        "q", ["qtr1", "qtr2", "qtr3", "qtr4"]).agg(F.first("value"))
    assert rows(back) == rows(df.select("fiscal_year", "indicator", "qtr1", "qtr2", "qtr3", "qtr4"))


def test_reshape_quarters_repeats_target_and_runs_within_the_year(spark, rows):
    df = spark.createDataFrame(
        [(2022, "a", 1.0, 2.0, 3.0, 4.0, 10.0, 10.0), (2023, "a", 5.0, None, 1.0, 1.0, 20.0, 7.0)], WIDE)
    got = rows(reshape_quarters(df), "period", "results", "results_cumulative", "targets")
    assert got[3] == ("FY22Q4", 4.0, 10.0, 10.0)
    assert got[4:6] == [("FY23Q1", 5.0, 5.0, 20.0), ("FY23Q2", None, 5.0, 20.0)]


def test_pivot_and_order(spark):
    df = spark.createDataFrame(
        [("b", "x", 1.0), ("b", "x", 2.0), ("a", "y", None), ("zz", "x", 1.0)], "i STRING, p STRING, t DOUBLE")
    wide = custom_order(pivot_sum(df, ["i"], "p", "t", ["x", "y"]), "i", ["b", "a"])
    assert [tuple(r) for r in wide.collect()] == [
        ("b", 3.0, None, 1), ("a", None, 0.0, 2), ("zz", 1.0, None, None)]


def test_pivot_keeps_unlisted_and_null_names(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "b", 2.0), ("a", None, 4.0), ("a", "a", 8.0)], "i STRING, p STRING, t DOUBLE")
    wide = pivot_sum(df, ["i"], "p", "t", ["x", "unused"])
    assert wide.columns == ["i", "x", "unused", "NA", "a", "b"]
    assert tuple(wide.first()) == ("a", 1.0, None, 4.0, 8.0, 2.0)


def test_series_only_for_groups_that_exist(spark, rows):
    df = spark.createDataFrame(CELLS, PERIODS)
    series = complete_series(df, ["mod_type", "mech_name"], "period_key", ["period"])
    grid = complete_grid(df, ["mech_name"], ["mod_type", ("period_key", "period")])
    last = df.groupBy("mod_type", "mech_name").agg(F.max("period_key").alias("_last"))
    same = (grid["mod_type"] == last["mod_type"]) & grid["mech_name"].eqNullSafe(last["mech_name"])
    expected = grid.join(last, same & (grid["period_key"] <= last["_last"]), "left_semi")
    assert rows(series) == rows(expected.select(*series.columns))


def test_names_are_replaced_and_keep_their_place(spark):
    names = spark.createDataFrame([("1", "A", "m")], "mech_code STRING, funding_agency STRING, mech_name STRING")
    df = spark.createDataFrame([("old", "1", "x", 2.0)], "mech_name STRING, mech_code STRING, funding_agency STRING, v DOUBLE")
    assert tuple(map_mech_names(df, names).select("mech_code", "v", "funding_agency", "mech_name").first()) == ("1", 2.0, "A", "m")
    crosswalk = spark.createDataFrame([("1", "old", "short")], "mech_code STRING, mech_name STRING, mech_name_short STRING")
    assert fix_mech_names(df, crosswalk).columns == ["mech_name", "mech_code", "funding_agency", "v", "mech_name_short"]


@pytest.mark.parametrize("size", [1, 2, 7, 4000, 4001])
def test_exact_median(spark, size):
    random.seed(size)
    data = [(c, float(random.choice([random.randint(0, 9), random.randint(0, 10**6)])))
            for c in "ab" for _ in range(size)]
    df = spark.createDataFrame([*data, ("a", None)], "c STRING, v DOUBLE").repartition(4)
    got = {r["c"]: r["median"] for r in exact_median(df, "c", "v").collect()}
    assert got == {c: statistics.median(v for k, v in data if k == c) for c in "ab"}


@pytest.mark.parametrize("value", [
    "cast(id as double)", "exp(rand(3) * 40)", "cast(id % 7 as double)", "if(id < 9000, 0D, 1D)",
    "-randn(5)", "1e9 + rand(1)", "cast(id as double) - 3000", "5D",
])
def test_exact_median_of_many_shapes(spark, value):
    df = spark.range(20_001).selectExpr("if(id % 3 = 0, 'a', if(id % 1000 = 1, 'b', null)) c", f"{value} v")
    df = spark.createDataFrame(df.collect(), "c STRING, v DOUBLE").repartition(6)
    expected = {r["c"]: r["m"] for r in df.groupBy("c").agg(F.median("v").alias("m")).collect()}
    assert {r["c"]: r["median"] for r in exact_median(df, "c", "v").collect()} == expected


def test_category_order_breaks_ties_by_label(spark, rows):
    df = spark.createDataFrame(
        [("b", 1.0), ("b", 3.0), ("a", 2.0), ("c", 9.0)], "c STRING, v DOUBLE")
    assert rows(category_order(df, "c", "v")) == [("a", 2.0, 2), ("b", 2.0, 3), ("c", 9.0, 1)]


PERIODS = "mod_type STRING, mech_name STRING, period STRING, period_key INT, value DOUBLE"
CELLS = [
    ("Index", "m1", "FY23Q1", 8093, 2.0), ("Other", "m1", "FY23Q1", 8093, 6.0),
    ("Index", "m2", "FY23Q3", 8095, 0.0), ("Index", None, "FY23Q2", 8094, 5.0),
]


def test_shares(spark, rows):
    df = spark.createDataFrame(CELLS, PERIODS)
    shared = share_of_period(df)
    assert rows(shared, "mod_type", "mech_name", "contribution") == [
        ("Index", None, 1.0), ("Index", "m1", 0.25), ("Index", "m2", None), ("Other", "m1", 0.75)]
    sums = shared.groupBy("period").agg(F.sum("contribution").alias("s")).collect()
    assert {r["period"]: r["s"] for r in sums} == {"FY23Q1": 1.0, "FY23Q2": 1.0, "FY23Q3": None}
    ends = start_end(shared)
    assert rows(ends, "start")[-1] == (0.75,) and rows(ends.filter("end is not null")) == []
    assert rows(share_of_group(df, ["mech_name"]), "contribution") == rows(shared, "contribution")


def test_complete_grid_counts_and_totals(spark, rows):
    df = spark.createDataFrame(CELLS, PERIODS)
    grid = complete_grid(df, ["mech_name"], ["mod_type", ("period_key", "period")])
    assert grid.count() == 3 * 2 * 3
    assert rows(grid.filter("value is not null")) == rows(df)
    totals = rows(period_totals(grid, ["mech_name"]).filter("period_key = 8093").select(
        "mech_name", "pd_tot", "pd_25", "pd_75").distinct())
    assert totals == [(None, 0.0, 0.0, 0.0), ("m1", 8.0, 2.0, 6.0), ("m2", 0.0, 0.0, 0.0)]


def test_complete_grid_with_no_key_and_with_two(spark):
    df = spark.createDataFrame(CELLS, PERIODS).withColumn("agency", F.upper("mech_name"))
    two = complete_grid(df, ["mech_name", "agency"], ["mod_type", ("period_key", "period")])
    assert two.count() == two.distinct().count() == 3 * 3 * 2 * 3
    assert two.select("mech_name", "agency").distinct().count() == 3 * 3
    sums = df.groupBy("mod_type", "period", "period_key").agg(F.sum("value").alias("value"))
    assert complete_grid(sums, [], ["mod_type", ("period_key", "period")]).count() == 6


def test_complete_grid_refuses_duplicates(spark):
    df = spark.createDataFrame([*CELLS, CELLS[0]], PERIODS)
    with pytest.raises(Exception, match="more than one row per cell"):
        complete_grid(df, ["mech_name"], ["mod_type", ("period_key", "period")]).collect()


def test_fill_up_gaps(spark, rows):
    data = [("lead", 1, None), ("lead", 2, 5), ("inner", 1, 3), ("inner", 2, None), ("inner", 3, 4),
            ("trail", 1, 7), ("trail", 2, None), ("empty", 1, None)]
    df = spark.createDataFrame(data, "g STRING, o INT, v INT")
    filled = fill_up(df, "v", ["g"], "o")
    assert rows(filled) == [("empty", 1, None), ("inner", 1, 3), ("inner", 2, 4), ("inner", 3, 4),
                            ("lead", 1, 5), ("lead", 2, 5), ("trail", 1, 7), ("trail", 2, None)]
    assert rows(fill_up(filled, "v", ["g"], "o")) == rows(filled)


def _filled(values):
    last, out = None, []
    for value in values:
        last = value if value is not None else last
        out.append(last)
    return out


@pytest.mark.parametrize("block", [1, 3, 50, 10**6])
def test_fill_down_over_the_whole_table(spark, block):
    random.seed(block)
    values = [f"v{i}" if random.random() < 0.03 else None for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "o BIGINT, v STRING").repartition(7)
    got = fill_down(df, "v", ["o"], blocks=block).orderBy("o").collect()
    assert [r["v"] for r in got] == _filled(values)


@pytest.mark.parametrize("block", [2, 10**6])
def test_fill_down_by_group_does_not_run_on(spark, rows, block):
    data = [("a", 1, "x"), ("a", 2, None), ("a", 5, None), ("b", 1, None), ("b", 2, "y"), ("b", 9, None), (None, 1, "z"), (None, 4, None)]
    df = spark.createDataFrame(data, "g STRING, o INT, v STRING")
    got = rows(fill_down(df, "v", ["o"], group=["g"], blocks=block))
    assert got == [(None, 1, "z"), (None, 4, "z"), ("a", 1, "x"), ("a", 2, "x"), ("a", 5, "x"),
                   ("b", 1, None), ("b", 2, "y"), ("b", 9, "y")]


def test_fill_down_with_a_compound_order(spark):
    random.seed(5)
    keys = [(a, b, c) for a in range(3) for b in (0, 4, 900) for c in range(1, 30)]
    values = ["k%d-%d-%d" % k if random.random() < 0.05 else None for k in keys]
    df = spark.createDataFrame([(*k, v) for k, v in zip(keys, values)], "a INT, b BIGINT, c INT, v STRING")
    got = fill_down(df.repartition(5), "v", ["a", "b", "c"], few=["a"], blocks=10).orderBy("a", "b", "c")
    assert [r["v"] for r in got.collect()] == _filled(values)


@pytest.mark.parametrize("block", [3, 1000])
def test_row_index_and_every_nth(spark, rows, block):
    df = spark.createDataFrame([(k * k,) for k in range(40)], "o BIGINT").repartition(5)
    assert rows(row_index(df, ["o"], blocks=block)) == [(k * k, k) for k in range(40)]
    assert rows(every_nth(df, 7, ["o"], blocks=block)) == [(k * k,) for k in range(0, 40, 7)]
    by_group = df.withColumn("g", F.col("o") % 2)
    got = rows(every_nth(by_group, 10, ["o"], group=["g"], blocks=block))
    assert got == sorted([(0, 0), (400, 0), (1, 1), (441, 1)])


def test_compare_columns(spark):
    x = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x STRING")
    y = spark.createDataFrame([("b",), ("c",), ("d",), (None,)], "y STRING")
    assert tuple(compare_columns(x, y).first()) == (
        1, 2, "only in x: 1, only in y: 2")
    assert tuple(compare_columns(x, x).first()) == (0, 0, "both hold the same values")


def test_bind_rows_fills_missing_columns(spark, rows):
    a = spark.createDataFrame([(1, "x")], "i INT, s STRING")
    b = spark.createDataFrame([(2, 0.5)], "i INT, d DOUBLE")
    assert rows(bind_rows(a, b, a)) == [(1, "x", None), (1, "x", None), (2, None, 0.5)]


def test_fix_mech_names_matches_null_and_multiplies(spark, rows):
    schema = "mech_code STRING, mech_name STRING"
    df = spark.createDataFrame([("1", "one"), ("2", "two"), (None, "gone"), ("3", "three")], schema)
    cw = spark.createDataFrame(
        [("1", "one", "O"), ("2", "other", "T"), (None, "gone", "G"), ("3", "three", "A"), ("3", "three", "B")],
        schema + ", mech_name_short STRING")
    assert rows(fix_mech_names(df, cw)) == [
        (None, "G", "G"), ("1", "O", "O"), ("2", "two", None), ("3", "A", "A"), ("3", "B", "B")]
    with pytest.raises(Exception, match="lists a mechanism twice"):
        fix_mech_names(df, cw, check_keys=True).collect()
    assert fix_mech_names(df, cw.filter("mech_name_short not in ('A')"), check_keys=True).count() == 4


def test_metadata_uses_the_last_quarter_with_data(spark):
    df = spark.createDataFrame(
        [(2022, "a", 1.0, 1.0, 1.0, 1.0, 1.0, 4.0), (2023, "a", 1.0, 0.0, None, None, 9.0, 1.0),
         (2024, "a", None, None, None, None, 9.0, None)], WIDE)
    meta = read_metadata(df, "s")
    assert meta == Metadata(2023, 2, "s") and (meta.curr_pd, meta.curr_key) == ("FY23Q2", 8094)
    with pytest.raises(ValueError):
        read_metadata(df.filter("fiscal_year = 2024"), "s")


def test_brief_compares_with_the_quarter_before_across_years(spark, rows):
    data = [(2022, "a", "X", 1.0, 2.0, 3.0, 4.0, 10.0), (2023, "a", "X", 6.0, 0.0, 0.0, 0.0, 12.0),
            (2023, "b", "X", 6.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(
        data, "fiscal_year INT, indicator STRING, funding_agency STRING, qtr1 DOUBLE, qtr2 DOUBLE, qtr3 DOUBLE, qtr4 DOUBLE, targets DOUBLE")
    got = rows(brief(df, ["indicator"], Metadata(2023, 1, "s")),
               "indicator", "funding_agency", "results", "prior_results", "change", "achievement", "direction")
    assert got == [("a", "Total", 6.0, 4.0, 2.0, 0.5, "up"), ("a", "X", 6.0, 4.0, 2.0, 0.5, "up"),
                   ("b", "Total", 6.0, None, None, None, None), ("b", "X", 6.0, None, None, None, None)]
