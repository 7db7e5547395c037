"""The registered queries: one per operator or report, over the whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterline.functions import classify, labels
from quarterline.functions.sql import register_sql_functions
from quarterline.functions.predicates import not_in
from quarterline.operators import achievement as ach
from quarterline.operators.aggregate import (
    category_order, distinct_rows, snapshot_metadata, sum_across, total,
)
from quarterline.operators.combine import (
    bind_rows, compare_columns, fix_mech_names, map_mech_names,
)
from quarterline.operators.buckets import in_buckets, short_names
from quarterline.operators.grid import complete_grid, complete_wide
from quarterline.operators.ordered import every_nth, fill_up
from quarterline.operators.reshape import custom_order, reshape_long, reshape_quarters
from quarterline.operators.sketches import merge_sketches, sketched_medians, sketched_order, value_sketches
from quarterline.operators.summaries import kept_sums, update_sums
from quarterline.operators.shares import (
    period_totals, share_of_group, share_of_period, start_end,
)
from quarterline.plans import achievement as reports
from quarterline.plans import modality, targets
from quarterline.sources import harvest as area
from quarterline.sources.snapshots import (
    latest_snapshot, newest_results, profile, read_checked, read_indicators, read_targets, targets_of_type, write_by,
    write_csv,
)
from quarterline.session import land, landing_place, stage
from quarterline.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEARS = (2022, 2023, 2024)
AGENCY = "ASIA"
#: presentation order of the indicators of this data; SMALL is left out on purpose
LEVELS = (
    "PROMO", "PROMO_D", "STANDARD", "STANDARD_D", "ECONOMY", "ECONOMY_D",
    "MEDIUM", "MEDIUM_D", "LARGE", "LARGE_D",
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
AGENCIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
TABLE_INDICATORS = ("PROMO", "PROMO_D", "SMALL", "LARGE_D")
CARRY = ("request_id", "iso", "indicator", "sex", "age", "period")
BASE_URL = "https://estimates.example.org/api/data?"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def named(name: str) -> Callable[[Query], Query]:
    """Register under a name that an imported function has already."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


# -- sources ------------------------------------------------------------------


@query
def scan_latest_snapshot(spark, sf_dir):
    path = latest_snapshot(spark, sf_dir, r"^lineitem.*\.parquet$")
    return spark.read.parquet(path).groupBy("l_returnflag").agg(
        F.lit(path.rsplit("/", 1)[-1]).alias("snapshot"),
        F.count("*").alias("n_rows"),
        F.sum("l_quantity").alias("quantity"),
    )


@query
def scan_msd(spark, sf_dir):
    return t.msd(spark, sf_dir)


@named("read_indicators")
def read_landed_indicators(spark, sf_dir):
    """The results table as a landed snapshot, through the reader and its schema."""
    return read_indicators(spark, land(t.msd(spark, sf_dir)))


@named("read_targets")
def read_landed_targets(spark, sf_dir):
    return read_targets(spark, land(t.tst(spark, sf_dir)), "PSNUxIM")


@named("snapshot_metadata")
def snapshot_metadata_query(spark, sf_dir):
    """From a snapshot landed by year: its folders name the years, and the newest one with results is read."""
    path = f"{landing_place(spark)}/snapshot"
    write_by(t.msd(spark, sf_dir), path, "fiscal_year")
    return snapshot_metadata(newest_results(spark, path), t.SOURCE)


@query
def scan_targets_by_type(spark, sf_dir):
    return targets_of_type(t.tst(spark, sf_dir), "ALL")


@named("map_mech_names")
def map_mech_names_on_read(spark, sf_dir):
    sums = sum_across(t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "targets")
    return map_mech_names(sums, t.mechanisms(spark, sf_dir))


@query
def request_grid_urls(spark, sf_dir):
    grid = area.request_grid(t.countries(spark, sf_dir))
    return grid.select(
        "country", "iso", "batch_no", "indicator", "age", "sex",
        area.request_url(BASE_URL).alias("url"),
    )


@query
def parse_csv_payloads(spark, sf_dir):
    return area.parse_payloads(t.responses(spark, sf_dir), CARRY)


@named("failed_requests")
def failed_payload_requests(spark, sf_dir):
    return area.failed_requests(t.faulty_responses(spark, sf_dir), ("request_id", "iso", "indicator"))


@named("rejected_lines")
def rejected_payload_lines(spark, sf_dir):
    rejected = area.rejected_lines(t.faulty_responses(spark, sf_dir), ("request_id", "iso", "indicator"))
    return rejected.withColumn("fields", F.array_join("fields", ","))


@query
def accepted_and_rejected_lines(spark, sf_dir):
    """What became of the requests and lines of each indicator."""
    by = ("indicator",)
    faulty = area.read_payloads(t.faulty_responses(spark, sf_dir), by)
    parts = {
        "accepted_line": area.parse_payloads(faulty, by),
        "rejected_line": area.rejected_lines(faulty, by),
        "failed_request": area.failed_requests(faulty, by),
    }
    counts = [df.groupBy(*by).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, df in parts.items()]
    return bind_rows(*counts)


@query
def profile_table(spark, sf_dir):
    return profile(t.msd(spark, sf_dir), "exact")


@query
def profile_table_counts(spark, sf_dir):
    return profile(t.msd(spark, sf_dir), None)


# -- projections, classification, predicates ----------------------------------


def _msd_keys(df):
    return df.select(
        "fiscal_year", "indicator", "standardizeddisaggregate", "modality",
        "funding_agency", "mech_code", "targets", "cumulative",
    )


@query
def filter_conjunctive(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return _msd_keys(df).filter(
        (F.col("indicator") == t.INDICATOR)
        & (F.col("standardizeddisaggregate") == t.DISAGGREGATE)
        & (F.col("fiscal_year") <= t.current(spark, sf_dir).curr_fy)
    )


@query
def filter_in_list(spark, sf_dir):
    return _msd_keys(t.msd(spark, sf_dir)).filter(F.col("indicator").isin("PROMO", "LARGE"))


@query
def filter_not_in_list(spark, sf_dir):
    kept = t.tst(spark, sf_dir).filter(
        not_in(F.col("standardizeddisaggregate"), targets.KEY_POPULATION_DISAGGREGATES)
    )
    return kept.groupBy("indicator", "standardizeddisaggregate").agg(
        F.count("*").alias("n_rows"), total("targets").alias("targets")
    )


@query
def filter_exclusions(spark, sf_dir):
    return _msd_keys(t.msd(spark, sf_dir)).filter(
        (F.col("funding_agency") != "EUROPE") & (F.col("mech_code") != "7")
    )


@query
def filter_fy_range(spark, sf_dir):
    return _msd_keys(t.msd(spark, sf_dir)).filter(F.col("fiscal_year").between(2019, 2021))


@query
def classify_modality(spark, sf_dir):
    mod_type = classify.modality_type(F.col("modality"), t.MODALITY_RULES)
    return t.msd(spark, sf_dir).groupBy("modality", mod_type.alias("mod_type")).agg(
        F.count("*").alias("n_rows"), total("cumulative").alias("cumulative")
    )


@query
def classify_index_other(spark, sf_dir):
    mod_type = classify.index_or_other(F.col("modality"), t.INDEX_RULES)
    return t.msd(spark, sf_dir).groupBy("modality", mod_type.alias("mod_type")).agg(
        F.count("*").alias("n_rows"), total("cumulative").alias("cumulative")
    )


@query
def age_coarse(spark, sf_dir):
    return sum_across(
        t.tst(spark, sf_dir),
        ["fiscal_year", "indicator", classify.age_coarse(F.col("ageasentered")).alias("trendscoarse")],
        "targets",
    )


@query
def clean_agency(spark, sf_dir):
    agency = labels.clean_agency(F.col("funding_agency"), {"EUROPE": "Europe office"})
    return sum_across(
        t.tst(spark, sf_dir), ["funding_agency", agency.alias("clean_name")], "targets"
    )


@query
def clean_indicator(spark, sf_dir):
    return sum_across(
        targets.with_clean_indicator(t.tst(spark, sf_dir)),
        ["fiscal_year", "numeratordenom", "indicator"], "targets",
    )


# -- joins, sets --------------------------------------------------------------


@named("fix_mech_names")
def fix_mech_names_short(spark, sf_dir):
    keys = ["mech_code", "mech_name", "fiscal_year", "indicator"]
    sums = sum_across(t.msd(spark, sf_dir), keys, "cumul")
    return fix_mech_names(sums, t.mech_names_cw(spark, sf_dir))


@named("compare_columns")
def compare_mech_codes(spark, sf_dir):
    # which mechanisms have a short name is the question: those without one are the differences
    reported = t.msd(spark, sf_dir).select("mech_code")
    named = t.mech_names_cw(spark, sf_dir).filter(F.col("mech_name_short").isNotNull())
    return compare_columns(reported, named.select("mech_code"))


@query
def union_by_name(spark, sf_dir):
    # the target table is a long derivation: sum it once for both parts
    keys = ["type", "fiscal_year", "indicator", "snuprioritization", "funding_agency"]
    sums = stage(sum_across(
        t.tst(spark, sf_dir).filter(F.col("type").isin("SUBNAT", "ALL")), keys, "targets"))
    by_place = sum_across(
        targets_of_type(sums, "SUBNAT"), ["fiscal_year", "indicator", "snuprioritization"], "targets"
    )
    by_agency = sum_across(
        targets_of_type(sums, "ALL"), ["fiscal_year", "indicator", "funding_agency"], "targets"
    )
    return bind_rows(by_place, by_agency)


@query
def union_indicators(spark, sf_dir):
    # one pass over the responses: the indicator says which of the bound tables a row is from
    source = F.array_position(F.array(*map(F.lit, area.INDICATORS)), F.col("indicator")).cast("int")
    return area.parse_payloads(t.responses(spark, sf_dir), CARRY).withColumn("src_no", source)


@query
def distinct_pairs(spark, sf_dir):
    return distinct_rows(t.msd(spark, sf_dir), "mech_code", "mech_name")


# -- aggregation, reshape -----------------------------------------------------


@query
def agg_across_pattern(spark, sf_dir):
    return sum_across(
        t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "targets|qtr"
    )


@named("reshape_long")
def reshape_long_periods(spark, sf_dir):
    ids = ["indicator", "standardizeddisaggregate", "modality", "funding_agency", "mech_code"]
    return reshape_long(t.msd(spark, sf_dir).drop("mech_name"), ids)


@named("reshape_quarters")
def reshape_quarters_periods(spark, sf_dir):
    sums = sum_across(
        t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "targets|qtr"
    )
    return reshape_quarters(sums)


@query
def achievement_quarters(spark, sf_dir):
    return reports.quarterly_achievement(t.msd(spark, sf_dir), [t.INDICATOR], YEARS)


@query
def achievement_grouping_sets(spark, sf_dir):
    return reports.achievement_grouping_sets(t.msd(spark, sf_dir), YEARS)


@query
def achievement_by_mech(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.achievement_by_mech(
        df, ["PROMO", "LARGE", "SMALL"], t.current(spark, sf_dir),
        agencies_out=["EUROPE"], names_out=["Supplier#000000003"], codes_out=["7"],
    )


@query
def achievement_bands(spark, sf_dir):
    sums = sum_across(
        t.msd(spark, sf_dir), ["fiscal_year", "mech_code"], "cumul|targets"
    )
    rated = ach.adorn_achievement(ach.calc_achievement(sums), quarter=3)
    return rated.select("fiscal_year", "mech_code", "achievement", "band")


@query
def achievement_table(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.achievement_table(
        df, ["PROMO", "LARGE", "SMALL"], t.current(spark, sf_dir),
        agencies_out=["EUROPE"], names_out=["Supplier#000000003"], codes_out=["7"],
    )


@query
def period_brief(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.period_brief(df, t.current(spark, sf_dir))


@query
def period_brief_one_indicator(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.period_brief(df, t.current(spark, sf_dir), [t.INDICATOR])


@query
def mech_summary(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.mech_summary(df, t.current(spark, sf_dir))


@query
def table_prioritization(spark, sf_dir):
    return targets.table_prioritization(
        targets_of_type(t.tst(spark, sf_dir), "ALL"), 2023, SEGMENTS, TABLE_INDICATORS, LEVELS
    )


@query
def table_agency(spark, sf_dir):
    return targets.table_agency(
        targets_of_type(t.tst(spark, sf_dir), "PSNUxIM"), 2023, AGENCIES, TABLE_INDICATORS, LEVELS
    )


@named("custom_order")
def custom_order_totals(spark, sf_dir):
    return custom_order(
        sum_across(t.msd(spark, sf_dir), ["indicator"], "cumul|targets"), "indicator", LEVELS
    )


# -- modality: steps and whole reports ----------------------------------------


def _mech_periods(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    rows = modality.modality_rows(
        df, t.current(spark, sf_dir).curr_fy,
        classify.modality_type(F.col("modality"), t.MODALITY_RULES),
        t.INDICATOR, t.DISAGGREGATE,
    )
    return modality.modality_periods(rows, ["mech_name"])


@named("share_of_period")
def share_of_period_total(spark, sf_dir):
    return share_of_period(_mech_periods(spark, sf_dir))


@query
def share_of_period_keys(spark, sf_dir):
    return share_of_group(_mech_periods(spark, sf_dir), ["mech_name"])


@query
def start_end_contribution(spark, sf_dir):
    return start_end(share_of_period(_mech_periods(spark, sf_dir)))


@named("category_order")
def category_order_by_median(spark, sf_dir):
    return category_order(_mech_periods(spark, sf_dir), "mod_type", "value")


@named("complete_grid")
def complete_grid_cells(spark, sf_dir):
    return complete_grid(
        _mech_periods(spark, sf_dir), ["mech_name"], ["mod_type", ("period_key", "period")]
    )


@named("fill_up")
def fill_up_periods(spark, sf_dir):
    grid = complete_grid_cells(spark, sf_dir)
    return fill_up(grid, "value", ["mod_type", "mech_name"], "period_key")


@named("period_totals")
def period_totals_by_mech(spark, sf_dir):
    return period_totals(complete_grid_cells(spark, sf_dir), ["mech_name"])


@named("every_nth")
def every_nth_period(spark, sf_dir):
    series = reshape_long(
        sum_across(t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "^qtr")
    )
    return every_nth(series, 3, ["period_key"], group=["indicator", "mech_code"], few=["period_key"])


@query
def every_nth_order(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return every_nth(orders, 10, ["o_orderkey"])


@query
def modality_by_mech(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return modality.modality_by_mech(
        df, t.current(spark, sf_dir).curr_fy, "FY20Q1", t.MODALITY_RULES, t.INDICATOR, t.DISAGGREGATE
    )


@query
def modality_index(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return modality.modality_index(
        df, "funding_agency", curr_fy=t.current(spark, sf_dir).curr_fy,
        rules=t.INDEX_RULES, indicator=t.INDICATOR, disaggregate=t.DISAGGREGATE,
    )


@query
def modality_index_two_keys(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return modality.modality_index(
        df, "funding_agency", "mech_name", curr_fy=t.current(spark, sf_dir).curr_fy,
        rules=t.INDEX_RULES, indicator=t.INDICATOR, disaggregate=t.DISAGGREGATE,
    )


# -- labels -------------------------------------------------------------------


@query
def clean_number(spark, sf_dir):
    sums = sum_across(
        t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "cumul|targets"
    )
    x = F.col("cumulative")
    return sums.select(
        "fiscal_year", "indicator", "mech_code",
        labels.clean_number(x).alias("as_is"),
        labels.clean_number(x * 500).alias("thousands"),
        labels.clean_number(x * 500000).alias("millions"),
        labels.clean_number(x * -1).alias("negative"),
        labels.clean_number(F.nullif(x, F.lit(0.0)), na_text="NA").alias("missing"),
        labels.clean_number(x * 50, digits=1).alias("one_digit"),
    )


@query
def format_achievement(spark, sf_dir):
    sums = sum_across(
        t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "cumul|targets"
    )
    x, y = F.col("cumulative"), F.col("targets")
    return sums.select(
        "fiscal_year", "indicator", "mech_code",
        labels.format_achievement(x, y).alias("plain"),
        labels.format_achievement(x * 500, y * -50000).alias("scaled"),
        labels.format_achievement(x, F.nullif(y, F.lit(0.0))).alias("missing"),
    )


@query
def indicator_words(spark, sf_dir):
    title = F.concat_ws(" ", "p_type", "p_brand")
    text = F.when(
        F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", "p_brand", "p_type")
    ).otherwise(F.col("p_name"))
    shade = F.concat_ws(" ", "p_brand", F.lit("shade"))
    return t.table(spark, sf_dir, "part").select(
        "p_partkey", *labels.indicator_words(title, text, shade)
    )


@query
def label_percent_comma(spark, sf_dir):
    sums = sum_across(
        t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "targets|qtr"
    )
    labelled = ach.add_chart_labels(ach.add_ratio(reshape_quarters(sums)))
    return labelled.select(
        "indicator", "mech_code", "period", "achv_label", "results_label", "targets_label"
    )


# -- figures ------------------------------------------------------------------


@query
def chart_achievement_all(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.chart_current(df, [t.INDICATOR], YEARS, t.current(spark, sf_dir))


@query
def chart_achievement_agency(spark, sf_dir):
    df = t.msd(spark, sf_dir)
    return reports.chart_current(df, [t.INDICATOR], YEARS, t.current(spark, sf_dir), AGENCY)


@query
def chart_trend(spark, sf_dir):
    return reports.chart_trend(
        t.msd(spark, sf_dir), [t.INDICATOR], YEARS, ("FY22Q2", "FY22Q4", "FY23Q2"), AGENCY, "FY22Q4"
    )


# -- area estimates -----------------------------------------------------------


@query
def label_age_period(spark, sf_dir):
    estimates = area.parse_payloads(t.responses(spark, sf_dir), CARRY)
    raw = estimates.select(
        "*", F.col("age").alias("age_code"), F.col("period").alias("period_code")
    )
    return area.label_estimates(raw).groupBy("age_code", "age", "period_code", "period").agg(
        F.count("*").alias("n_rows")
    )


@query
def fill_operating_unit(spark, sf_dir):
    return area.harvest(t.responses(spark, sf_dir), CARRY)


@query
def fill_operating_unit_levels(spark, sf_dir):
    return area.harvest(t.responses(spark, sf_dir), CARRY, levels=(2,))


@query
def fill_operating_unit_run_on(spark, sf_dir):
    carry = ("batch_no", "country_no", "iso", "indicator", "sex", "age")
    return area.run_on_units(t.responses(spark, sf_dir), carry, order=("batch_no", "country_no"))


# -- kept and written tables --------------------------------------------------


@query
def read_rejects(spark, sf_dir):
    """A delimited snapshot in which some targets are no numbers: lines accepted and rejected by year."""
    df, path = t.msd(spark, sf_dir), landing_place(spark)
    bad = (F.col("fiscal_year") == 2020) & (F.col("funding_agency") == "EUROPE")
    faulty = df.withColumn("targets", F.when(bad, F.lit("unknown")).otherwise(F.col("targets").cast("string")))
    faulty.write.csv(path, sep="\t", header=True, nullValue="NA")
    accepted, rejected = read_checked(spark, path)
    year = F.split("line", "\t")[0].cast("int").alias("fiscal_year")
    return bind_rows(
        accepted.groupBy("fiscal_year").agg(F.lit("accepted").alias("kind"), F.count("*").alias("n")),
        rejected.groupBy(year).agg(F.lit("rejected").alias("kind"), F.count("*").alias("n")))


@query
def written_csv(spark, sf_dir):
    """The results table through a CSV file with a marker for NULL."""
    path = landing_place(spark)
    write_csv(t.msd(spark, sf_dir), path)
    return read_indicators(spark, path, "csv")


@query
def written_by_mech(spark, sf_dir):
    """The summaries of all mechanisms, written to a folder each and found again by their folders."""
    df, path = t.msd(spark, sf_dir), landing_place(spark)
    meta = t.current(spark, sf_dir)
    reports.write_mech_summaries(df, meta, path)
    summary = reports.mech_summary(df, meta)
    return spark.read.schema(summary.schema).parquet(path).select(*summary.columns)


def _mech_sketches(spark, sf_dir):
    """A stored sketch of the quarterly values of every mechanism and year, merged to one per mechanism."""
    values = reshape_long(sum_across(t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "^qtr"))
    year = F.floor((F.col("period_key") - 1) / 4).alias("year")
    yearly = stage(value_sketches(values.select("mech_code", year, "value"), ["year", "mech_code"], "value"))
    return merge_sketches(yearly, ["mech_code"])


@query
def sketch_medians(spark, sf_dir):
    return sketched_medians(_mech_sketches(spark, sf_dir), "mech_code")


@query
def sketch_top_mechs(spark, sf_dir):
    return sketched_order(_mech_sketches(spark, sf_dir), "mech_code", top=25)


@query
def incremental_sums(spark, sf_dir):
    """Sums kept by year, brought up to date with a snapshot that restates one year."""
    df, store = stage(t.msd(spark, sf_dir)), landing_place(spark)
    keys, pattern = ["indicator", "mech_code"], "targets|cumul|qtr"
    early = df.withColumn("cumulative", F.when(F.col("fiscal_year") != 2023, F.col("cumulative")))
    update_sums(early, store, keys, pattern)
    update_sums(df, store, keys, pattern)
    return kept_sums(spark, store)


@query
def fix_mech_names_in_buckets(spark, sf_dir):
    by = ["mech_code", "mech_name"]
    sums = in_buckets(sum_across(t.msd(spark, sf_dir), [*by, "fiscal_year", "indicator"], "cumul"), by)
    return short_names(sums, in_buckets(t.mech_names_cw(spark, sf_dir), by))


@query
def complete_wide_grid(spark, sf_dir):
    """Every year, modality and mechanism, though few mechanisms report each."""
    rows = t.msd(spark, sf_dir).filter((F.col("indicator") == t.INDICATOR) & F.col("cumulative").isNotNull())
    sums = stage(sum_across(rows, ["fiscal_year", "modality", "mech_code"], "cumul|targets"))
    return complete_wide(sums, ["fiscal_year", "modality"], "mech_code", {"targets": 0.0})


@query
def sql_functions(spark, sf_dir):
    """The scalar helpers in a query that is SQL text alone."""
    register_sql_functions(spark)
    sums = sum_across(t.msd(spark, sf_dir), ["fiscal_year", "indicator", "mech_code"], "cumul|targets")
    return spark.sql("""
        SELECT fiscal_year, indicator, mech_code, clean_number(cumulative * 500) AS thousands,
          format_achievement(cumulative * 500, targets * -50000) AS scaled,
          words(concat(indicator, ' of mechanism ', mech_code), 1, 3) AS first_words,
          age_label(concat('Y0', mech_code, '_0', fiscal_year)) AS age
        FROM {sums}""", sums=sums)
