"""The reports' input tables, derived from the given star schema.

Nothing is broadcast by hand: nation and region have a fixed size and Spark sees the
size of the others. The results table is aggregated by supplier key before names are
joined; the target table groups far above the supplier and is joined first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.functions.classify import Rule
from quarterline.operators.aggregate import read_metadata
from quarterline.schemas import INDICATOR_RESULTS, TARGETS, TOTAL_NUMERATOR, Metadata
from quarterline.session import shuffle_partitions
from quarterline.sources.harvest import request_grid

SOURCE = "results"
INDICATOR = "PROMO"
DISAGGREGATE = "Modality/Age/Sex/Result"

#: modality texts of this data are order priorities
MODALITY_RULES = (
    Rule("Index", "URGENT"),
    Rule("Other PITC", "HIGH"),
    Rule("PMTCT", "MEDIUM"),
    Rule("VCT", "5-LOW", exact=True),
)
INDEX_RULES = MODALITY_RULES[:1]

#: given tables; a stated schema saves the job that reads a footer for it
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _fiscal_year(date: str) -> Column:
    """Fiscal years start in October; +22 keeps all of them in one century."""
    late = F.when(F.month(date) >= 10, F.lit(1)).otherwise(F.lit(0))
    return (F.year(date) + 22 + late).cast("int")


def _agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def _quarter() -> Column:
    month = F.month("l_shipdate")
    return F.when(month >= 10, 1).when(month <= 3, 2).when(month <= 6, 3).otherwise(4)


def is_result() -> Column:
    return F.col("l_returnflag") == "A"


def msd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator results: one row per year, indicator, disaggregate, modality, mechanism."""
    quantity = F.col("l_quantity")
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    sums = lines.groupBy(
        _fiscal_year("l_shipdate").alias("fiscal_year"),
        F.col("p_type").alias("indicator"),
        F.when(F.col("l_linestatus") == "O", F.lit(TOTAL_NUMERATOR))
        .otherwise(F.lit(DISAGGREGATE)).alias("standardizeddisaggregate"),
        F.col("o_orderpriority").alias("modality"),
        "l_suppkey",
    ).agg(
        *[
            F.sum(F.when(is_result() & (_quarter() == q), quantity)).alias(f"qtr{q}")
            for q in (1, 2, 3, 4)
        ],
        F.sum(F.when(F.col("l_returnflag") == "R", quantity)).alias("targets"),
        F.sum(F.when(is_result(), quantity)).alias("cumulative"),
    )
    named = sums.join(
        _agencies(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")
    ).withColumns({
        "funding_agency": F.col("r_name"),
        "mech_code": F.col("s_suppkey").cast("string"),
        "mech_name": F.col("s_name"),
    })
    return named.select(*INDICATOR_RESULTS.fieldNames())


def current(spark: SparkSession, sf_dir: str) -> Metadata:
    """The reports' current period: the last quarter with a result.

    Read from the lines that results are made of, by three columns and without a join or a shuffle of rows; every line has
    its order, part and supplier, so the derived table says the same.
    """
    reported = table(spark, sf_dir, "lineitem").filter(is_result())
    latest = reported.filter(F.col("l_quantity").isNotNull()).agg(F.max("l_shipdate").alias("l_shipdate"))
    quarters = [F.when(_quarter() == q, F.lit(1.0)).alias(f"qtr{q}") for q in (1, 2, 3, 4)]
    return read_metadata(latest.select(_fiscal_year("l_shipdate").alias("fiscal_year"), *quarters), SOURCE)


def tst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target-setting table: targets by type, indicator, disaggregate, age, agency."""
    size = F.col("p_size")
    age = (
        F.when(size <= 5, "<01").when(size <= 10, "01-09").when(size <= 15, "10-14")
        .when(size <= 25, "15-24").when(size <= 35, "25-34").when(size <= 42, "35-49")
        .when(size <= 48, "50+").otherwise("Unknown")
    )
    # orders are far fewer than lines: they meet customers first; lines are summed per supplier
    # before the suppliers' names are attached
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            _fiscal_year("o_orderdate").alias("year"), "l_linestatus", "l_returnflag",
            (F.col("l_linenumber") % 2).alias("odd"), "p_type", age.alias("age"), "c_mktsegment", "l_suppkey")
        .agg(F.sum("l_quantity").alias("l_quantity"))
    )
    named = lines.join(_agencies(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    flag = F.col("l_returnflag")
    keys = {
        "fiscal_year": F.col("year"),
        "type": F.when(F.col("r_name") == "MIDDLE EAST", F.lit("SUBNAT"))
        .when(F.col("l_linestatus") == "F", F.lit("ALL")).otherwise(F.lit("PSNUxIM")),
        "indicator": F.col("p_type"),
        "numeratordenom": F.when(F.col("odd") == 0, F.lit("D")).otherwise(F.lit("N")),
        "standardizeddisaggregate": F.when(flag == "A", F.lit(TOTAL_NUMERATOR))
        .when(flag == "N", F.lit("KeyPop/Result")),
        "ageasentered": F.col("age"),
        "snuprioritization": F.col("c_mktsegment"),
        "funding_agency": F.when(
            F.col("n_nationkey") % 2 == 0, F.concat(F.lit("HHS/"), F.col("r_name"))
        ).otherwise(F.col("r_name")),
    }
    return named.groupBy(*[column.alias(name) for name, column in keys.items()]).agg(
        F.sum("l_quantity").alias("targets")
    ).select(*TARGETS.fieldNames())


def mech_names_cw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mechanism with its short name, which those with a high balance lack (NULL)."""
    code = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        code.alias("mech_code"), F.col("s_name").alias("mech_name"),
        F.when(F.col("s_acctbal") < 3000, F.concat(F.lit("S"), code)).alias("mech_name_short"),
    )


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agency, partner and name of every mechanism; partners of those in debt are unknown (NULL)."""
    return _agencies(spark, sf_dir).select(
        F.col("s_suppkey").cast("string").alias("mech_code"),
        F.col("r_name").alias("funding_agency"),
        F.when(F.col("s_acctbal") >= 0, F.col("n_name")).alias("prime_partner_name"),
        F.col("s_name").alias("mech_name"),
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harvest's country list, one per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("country_no"),
        F.col("c_name").alias("country"),
        F.concat(F.lit("C "), F.col("c_custkey").cast("string")).alias("iso"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request of the grid returned, as CSV text.

    A country has ``key % 5`` districts (level 2) after its own line (level 0), whose
    upper bound is not a number; every seventh country lacks the level-0 line.
    """
    key = F.col("country_no")

    def line(area: Column, level: str, mean: Column, upper: Column) -> Column:
        return F.concat_ws(
            ",", area, F.lit(level), mean.cast("string"), (mean - 1).cast("string"), upper
        )

    own = line(F.col("country"), "0", key * 100, F.lit("x"))
    districts = F.transform(
        F.sequence(F.lit(0).cast("bigint"), key % 5),
        lambda j: line(
            F.concat(F.lit('"District '), j.cast("string"), F.lit(", "), F.col("iso"), F.lit('"')), "2",
            key + j, (key + j + 1).cast("string"),
        ),
    )
    body = F.concat(
        F.array(F.lit("area,level,mean,lower,upper")),
        F.when(key % 7 != 0, F.array(own)).otherwise(F.array().cast("array<string>")),
        F.slice(districts, F.lit(2), F.size(districts)),
    )
    # small rows that unfold into many: spread them first, a small file is one task
    tasks = max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    spread = countries(spark, sf_dir).repartition(tasks, "country_no")
    # a country's text is written before its requests unfold: once, not per request
    return request_grid(spread.withColumn("payload", F.array_join(body, "\n"))).select(
        F.concat_ws("-", F.col("batch_no").cast("string"), key.cast("string")).alias("request_id"),
        "batch_no", "country_no", "iso", "indicator", "age", "sex", "period", "payload",
    )


def faulty_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with faults, by the last digit of the country: 3 no payload, 5 an error message, 8 a short line at the end."""
    digit = F.col("country_no") % 10
    payload = (
        F.when(digit == 3, F.lit(None).cast("string"))
        .when(digit == 5, F.lit('{"error": "indicator not recognised"}'))
        .when(digit == 8, F.concat("payload", F.lit("\nshort,2,1")))
        .otherwise(F.col("payload"))
    )
    return responses(spark, sf_dir).withColumn("payload", payload)
