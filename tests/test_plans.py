"""What the plans look like, and that hot keys and whole tables stay spread out."""

import re
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarterline import session
from quarterline.operators.aggregate import exact_median
from quarterline.operators.combine import fix_mech_names
from quarterline.operators.grid import complete_grid
from quarterline.operators.ordered import every_nth, fill_down, fill_up
from quarterline.operators.shares import period_totals
from quarterline.sources.snapshots import read_indicators, write_by
from quarterline.schemas import INDICATOR_RESULTS
from quarterline.workload import tables as t
from quarterline.workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    """Session settings for one block; ``__`` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: their last step orders a handful of rows: category ranks, one row per range, a top list
FEW_ROWS_TO_ONE_TASK = {
    "category_order", "modality_by_mech", "modality_index", "modality_index_two_keys",
    "every_nth", "every_nth_order", "fill_operating_unit_run_on", "sketch_top_mechs",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_single_task(spark, name):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in text
    singles = re.findall(r"Exchange SinglePartition.*\n\W*(.*)", text)
    keyless = [s for s in singles if re.match(r"\(?\d*\)?\s*(Object)?(Hash|Sort)Aggregate\(keys?=\[\]", s)]
    if name not in FEW_ROWS_TO_ONE_TASK:
        assert singles == keyless


def test_filters_and_columns_reach_the_scans(spark):
    with settings(spark, spark__sql__maxMetadataStringLength="5000"):
        text = plan(QUERIES["filter_conjunctive"](spark, SF_DIR))
    assert "EqualTo(p_type,PROMO)" in text
    lineitem = next(s for s in re.findall(r"ReadSchema: struct<(.*?)>", text) if "l_orderkey" in s)
    assert "l_tax" not in lineitem and "l_extendedprice" not in lineitem


def test_year_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "landed")
    write_by(t.msd(spark, SF_DIR), path, "fiscal_year")
    read = read_indicators(spark, path).filter(F.col("fiscal_year") == 2023)
    assert read.schema.fieldNames().sort() == INDICATOR_RESULTS.fieldNames().sort()
    assert re.search(r"PartitionFilters: \[.*fiscal_year.*= 2023", plan(read))
    assert read.count() == t.msd(spark, SF_DIR).filter("fiscal_year = 2023").count()


def test_grid_is_placed_once_for_all_that_follows(spark):
    df = spark.createDataFrame(
        [("Index", "m%d" % i, "FY23Q1", 8093, 1.0) for i in range(50)],
        "mod_type STRING, mech_name STRING, period STRING, period_key INT, value DOUBLE")
    grid = complete_grid(df, ["mech_name"], ["mod_type", ("period_key", "period")])
    both = period_totals(fill_up(grid, "value", ["mod_type", "mech_name"], "period_key"), ["mech_name"])
    after_union = plan(both).split("Union")[0]
    assert "Exchange" not in after_union


def _biggest_share(df) -> float:
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_one_hot_group_is_filled_by_many_tasks(spark):
    n = 30_000
    df = spark.range(n).select(
        F.lit("hot").alias("g"), F.col("id").alias("o"),
        F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"))
    with settings(
        spark, spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    ):
        filled = fill_down(df, "v", ["o"], group=["g"], blocks=500)
        assert _biggest_share(filled) < 0.35
        wrong = filled.filter(
            ~F.col("v").eqNullSafe(
                F.when(F.col("o") >= 7, F.floor((F.col("o") - 7) / 1000) * 1000 + 7)))
        assert filled.count() == n and wrong.count() == 0


@pytest.mark.parametrize("verb", [
    lambda df, n: fill_down(df, "v", ["o"], group=["g"], blocks=n), lambda df, n: every_nth(df, 7, ["o"], ["g"], blocks=n)])
def test_a_scan_shuffles_rows_once_and_holds_no_border(spark, verb):
    df = spark.range(20_000).selectExpr("id % 3 AS g", "id AS o", "if(id % 50 = 7, id, null) AS v")
    with settings(spark, spark__sql__shuffle__partitions="8"):
        few, many = (plan(verb(df, n)) for n in (2, 10 ** 6))
    # rows lie in buckets; what moves is a row per range
    assert few.count("Exchange hashpartitioning") == 1 and few.count("Exchange SinglePartition") == 1
    assert "Exchange hashpartitioning(_last" in few and "Bucketed: true" in few
    assert abs(len(many) - len(few)) < 300


@pytest.mark.parametrize("name", ["complete_grid", "share_of_period", "table_prioritization", "table_agency", "modality_by_mech"])
def test_the_fact_is_derived_once(spark, name, monkeypatch):
    """Eager jobs included: every order is read once."""
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    given = t.table

    def table(spark, sf_dir, name):
        df = given(spark, sf_dir, name)
        return df.mapInArrow(counted, df.schema) if name == "orders" else df

    monkeypatch.setattr(t, "table", table)
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    assert read.value == given(spark, SF_DIR, "orders").count()


def test_release_drops_staged_tables(spark):
    df = fill_down(spark.range(10).selectExpr("id AS o", "id AS v"), "v", ["o"])
    assert df.count() == 10 and spark.catalog.listTables(pattern="quarterline_staged_*")
    path = session._session_folder(spark)
    session.release(spark)
    assert not spark.catalog.listTables(pattern="quarterline_staged_*")
    assert not list(Path(path.removeprefix("file:")).glob("*"))


def test_a_local_warehouse_serves_a_local_master_only(spark):
    class Elsewhere:
        conf = spark.conf

        class sparkContext:
            master = "yarn"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.staging_folder(Elsewhere)
    assert session.staging_folder(spark)


def test_median_of_one_hot_category_sorts_only_its_bracket(spark):
    df = spark.range(200_000).select(
        F.lit("hot").alias("c"), ((F.col("id") * 7919) % 200_003).cast("double").alias("v"))
    expected = df.agg(F.median("v")).first()[0]
    got = exact_median(df, "c", "v")
    assert got.first()["median"] == expected
    assert "median(" not in plan(got).lower().replace("median outside", "")


def test_hot_mechanism_is_split_in_the_name_join(spark):
    schema = "mech_code STRING, mech_name STRING"
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("mech_code"),
        F.lit("name").alias("mech_name"), F.uuid().alias("filler"))
    cw = spark.createDataFrame([("hot", "name", "H"), ("1", "name", "one")], schema + ", mech_name_short STRING")
    with settings(
        spark, spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200KB",
        spark__sql__shuffle__partitions="16",
    ):
        out = fix_mech_names(df, cw)
        rows = out.collect()
        assert len(rows) == 200_000
        assert sum(r["mech_name"] == "H" for r in rows) == -(-200_000 // 3)
        assert "skew=true" in plan(out)


def test_a_hot_mechanism_folder_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("mech_code"),
        F.uuid().alias("text"))
    with settings(
        spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="500KB",
        spark__sql__shuffle__partitions="8",
    ):
        write_by(df, str(tmp_path / "m"), "mech_code")
    assert len(list((tmp_path / "m" / "mech_code=hot").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "m")).count() == 100_000
