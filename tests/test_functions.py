import pytest
from pyspark.sql import functions as F

from quarterline.functions import classify, labels
from quarterline.functions.predicates import matching_columns, not_in, number, ratio


def values(spark, data, kind, *exprs):
    """Each expression over column ``x``, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i INT, x {kind}")
    found = df.select("i", *[e(F.col("x")).alias(f"y{n}") for n, e in enumerate(exprs)]).orderBy("i")
    got = [tuple(r)[1:] for r in found.collect()]
    return [g[0] for g in got] if len(exprs) == 1 else got


def test_not_in_keeps_null_and_inequality_drops_it(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x STRING")
    assert {r[0] for r in df.filter(not_in(F.col("x"), ["a"])).collect()} == {"b", None}
    assert [r[0] for r in df.filter(F.col("x") != "a").collect()] == ["b"]


def test_number_and_ratio_give_null_instead_of_failing(spark):
    assert values(spark, ["1.5", "x", None, ""], "STRING", number) == [1.5, None, None, None]
    assert values(spark, [4.0, 0.0, None], "DOUBLE", lambda x: ratio(F.lit(8.0), x)) == [2.0, None, None]


def test_matching_columns_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "QTR1 INT, Targets INT, other INT")
    assert matching_columns(df, "targets|qtr") == ["QTR1", "Targets"]


def test_modality_first_match_wins(spark):
    texts = ["IndexMod", "OtherPITC", "PMTCT ANC", "VCT", "VCTMod", "SNSMod", "Emergency", None,
             "PMTCT Index"]
    assert values(spark, texts, "STRING", classify.modality_type) == [
        "Index", "Other PITC", "PMTCT", "VCT", "Other", "Community SNS", "Other", "Other", "Index"]
    assert values(spark, texts, "STRING", classify.index_or_other)[:2] == ["Index", "Other"]


def test_age_coarse(spark):
    ages = ["<01", "10-14", "15-24", "50+", "Unknown", None]
    assert values(spark, ages, "STRING", classify.age_coarse) == [
        "<15", "<15", "15+", "15+", "Unknown", None]


def test_achievement_band_borders(spark):
    full_year = lambda x: classify.achievement_band(x, 4)
    assert values(spark, [0.7499, 0.75, 0.9, 1.1, 1.1001, None], "DOUBLE", full_year) == [
        "<75%", "75-89%", "90-110%", "90-110%", "+110%", None]
    half_year = lambda x: classify.achievement_band(x, 2)
    assert values(spark, [0.5], "DOUBLE", half_year) == ["90-110%"]


def test_clean_number_rounds_half_even(spark):
    data = [2.5e3, 3.5e3, 999_500.0, 1e6, 2.5e9, 999.0, 12.25, 0.0, -5e6, None]
    assert values(spark, data, "DOUBLE", labels.clean_number) == [
        "2K", "4K", "1000K", "1M", "2B", "999", "12.25", "0", "-5000000", None]
    assert values(spark, [None], "DOUBLE", lambda x: labels.clean_number(x, na_text="NA")) == ["NA"]
    assert values(spark, [1250.0, 1350.0, 2000.0], "DOUBLE", lambda x: labels.clean_number(x, 1)) == [
        "1.2K", "1.4K", "2K"]


def test_plain_numbers_do_not_depend_on_ansi_mode(spark):
    data = [0.0, -0.0, 1e-7, 0.1 + 0.2, 999.5, -1234567.25, 1e-13, -2.5e-20]
    expected = ["0", "0", "0.0000001", "0.3", "999.5", "-1234567.25", "1e-13", "-2.5e-20"]
    assert values(spark, data, "DOUBLE", labels.clean_number) == expected
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert values(spark, data, "DOUBLE", labels.clean_number) == expected
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_format_achievement(spark):
    label = lambda x: labels.format_achievement(x, F.lit(20000.0))
    data = [12000.0, 999_500.0, -5e6, 1.5e12, 0.4, None]
    assert values(spark, data, "DOUBLE", label) == [
        "12K / 20K", "1000K / 20K", "-5M / 20K", "2T / 20K", "0 / 20K", None]


def test_percent_and_comma(spark):
    assert values(spark, [0.125, 0.135, 1.0, None], "DOUBLE", labels.percent_label) == [
        "12%", "14%", "100%", None]
    assert values(spark, [1234567.0, 0.0, None], "DOUBLE", labels.comma_label) == [
        "1,234,567", "0", None]


def test_words_need_enough_of_them(spark):
    three = lambda x: labels.words(x, 1, 3)
    assert values(spark, ["a b c d", "a b", "a  b", None], "STRING", three) == [
        "a b c", None, "a  b", None]
    cell = labels.indicator_cell(F.lit("TX new"), F.lit("on treatment now"), F.lit("red x"))
    text = spark.range(1).select(cell).first()[0]
    assert "TX" in text and "on treatment now" in text and "red" in text


def test_age_label_replaces_the_first_match_only(spark):
    codes = ["Y015_019", "Y020_024", "Y015_999", "Y0Y0", "a_0_0", "other", None]
    assert values(spark, codes, "STRING", labels.age_label) == [
        "15-19", "20-24", "15+", "Y0", "a-_0", "other", None]


def test_names(spark):
    assert values(spark, ["HHS/cdc", "Peace Corps", None], "STRING", labels.clean_agency) == [
        "CDC", "PEACE CORPS", None]
    renamed = lambda x: labels.clean_agency(x, {"CDC": "Centers"})
    assert values(spark, ["HHS/CDC", "DOD"], "STRING", renamed) == ["Centers", "DOD"]
    df = spark.createDataFrame([("T", "D"), ("T", "N"), ("T", None)], "i STRING, n STRING")
    got = df.select(labels.clean_indicator(F.col("i"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["T_D", "T", "T"]


@pytest.mark.parametrize("year,quarter,label,key", [(1999, 4, "FY99Q4", 8000), (2000, 1, "FY00Q1", 8001)])
def test_period_key_orders_across_a_century(spark, year, quarter, label, key):
    row = spark.range(1).select(
        labels.period_label(F.lit(year), F.lit(quarter)), labels.period_key(F.lit(year), F.lit(quarter))
    ).first()
    assert tuple(row) == (label, key)
