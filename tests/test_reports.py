"""Whole reports on a few hand-written rows."""

import pytest

from quarterline.plans import achievement as reports
from quarterline.plans import modality, targets
from quarterline.schemas import INDICATOR_RESULTS, TARGETS, Metadata
from quarterline.workload import tables

META = Metadata(2023, 2, "s")


def _results(spark, *rows):
    """(year, modality, agency, code, q1, q2, targets) of the report's own indicator."""
    data = [
        (y, modality.INDICATOR, modality.DISAGGREGATE, m, a, c, f"mech {c}", q1, q2, None, None, tgt, None)
        for y, m, a, c, q1, q2, tgt in rows
    ]
    return spark.createDataFrame(data, INDICATOR_RESULTS)


def test_modality_by_mech_keeps_leading_gaps_and_drops_trailing_ones(spark):
    df = _results(
        spark,
        (2022, "IndexMod", "A", "1", 2.0, 0.0, None), (2022, "VCT", "A", "1", 6.0, 0.0, None),
        (2023, "IndexMod", "A", "2", 5.0, 1.0, None), (2024, "VCT", "A", "2", 9.0, 9.0, None))
    got = {(r["mod_type"], r["mech_name"], r["period"]): r for r in modality.modality_by_mech(
        df, curr_fy=2023, begin_period="FY22Q1").collect()}
    # Index at mech 2 starts in FY23: its FY22 rows are there, empty
    early = got["Index", "mech 2", "FY22Q1"]
    assert early["value"] is None and early["mod_order"] is not None and early["pd_tot"] == 0.0
    # Index at mech 1 ends with FY22, and VCT at mech 2 never reports up to 2023
    assert ("Index", "mech 1", "FY23Q1") not in got and ("VCT", "mech 2", "FY22Q1") not in got
    first = got["Index", "mech 1", "FY22Q1"]
    assert (first["contribution"], first["start"], first["end"], first["pd_tot"]) == (0.25, 0.25, None, 8.0)
    assert (first["note"], first["mod_color"]) == ("HTS_TST_POS", "#855C75")
    # a period without any value has no share
    assert got["Index", "mech 1", "FY22Q3"]["contribution"] is None
    assert len(got) == 8 + 4 + 4


@pytest.mark.parametrize("keys,cells", [((), 16), (("funding_agency",), 16), (("funding_agency", "mech_name"), 24)])
def test_modality_index_by_any_keys(spark, keys, cells):
    df = _results(
        spark, (2022, "IndexMod", "A", "1", 1.0, 1.0, None), (2022, "VCT", "A", "1", 3.0, 1.0, None),
        (2023, "IndexMod", "A", "2", 1.0, 1.0, None), (2023, "PMTCT", "A", "2", 1.0, 1.0, None))
    out = modality.modality_index(df, *keys, curr_fy=2023)
    assert out.count() == cells
    first = out.filter("period = 'FY22Q1' and mod_type = 'Index' and value is not null").collect()
    assert [r["contribution"] for r in first] == [0.25]


def _totals(spark, *rows):
    data = [(2023, i, "Total Numerator", "m", a, c, n, q1, q2, 0.0, 0.0, tgt, cum)
            for i, a, c, n, q1, q2, tgt, cum in rows]
    return spark.createDataFrame(data, INDICATOR_RESULTS)


def test_achievement_table_excludes_and_labels(spark):
    df = _totals(
        spark, ("TX", "A", "1", "one", 0.0, 0.0, 20_000.0, 12_000.0), ("TX", "DEDUP", "1", "one", 0.0, 0.0, 1.0, 1.0),
        ("TX", "A", "9", "out", 0.0, 0.0, 1.0, 1.0), ("TX", "A", None, "unknown", 0.0, 0.0, 1.0, 1.0),
        ("TX", "A", "2", "two", 0.0, 0.0, 0.0, 5.0))
    got = {r["mech_code"]: r for r in reports.achievement_table(df, ["TX"], META, codes_out=["9"]).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["achievement"], got["1"]["band"], got["1"]["tgt_rslt_sum"]) == (0.6, "+110%", "12K / 20K")
    assert (got["2"]["achievement"], got["2"]["band"]) == (None, None)


def test_charts(spark):
    df = _totals(
        spark, ("OVC", "A", "1", "one", 100.0, 1200.0, 4000.0, None), ("OVC", "B", "2", "two", 0.0, 800.0, None, None))
    now = reports.chart_current(df, ["OVC"], [2022, 2023], META).first()
    assert (now["achv_label"], now["results_label"], now["targets_label"]) == ("50%", "2,000", "4,000")
    assert now["title"] == "OVC ACHIEVEMENT | ALL AGENCIES: FY23Q2"
    one = reports.chart_current(df, ["OVC"], [2023], META, "A").first()
    assert (one["funding_agency"], one["achv_label"]) == ("A", "30%")
    trend = {r["period"]: r for r in reports.chart_trend(
        df, ["OVC"], [2023], ["FY23Q1", "FY23Q2"], "A", "FY23Q1").collect()}
    assert trend["FY23Q1"]["targets_label"] is None and trend["FY23Q1"]["targets"] == 4000.0
    assert trend["FY23Q2"]["targets_label"] == "4,000"


def test_mech_summaries_are_written_by_mechanism(spark, tmp_path):
    df = _totals(
        spark, ("OVC", "A", "1", "one", 100.0, 1200.0, 4000.0, None), ("OVC", "B", "2", "two", 0.0, 800.0, None, None))
    reports.write_mech_summaries(df, META, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["mech_code=1", "mech_code=2"]
    one = spark.read.parquet(str(tmp_path / "out" / "mech_code=1")).filter("is_total = 1").first()
    assert (one["title"], one["results"], one["prior_results"], one["achievement"]) == (
        "one PERFORMANCE SUMMARY", 1200.0, 100.0, 0.325)
    assert one["caption"] == "Source: s | FY23Q2"


def test_target_tables(spark):
    rows = [
        (2025, "ALL", "HTS_TST", "N", None, "<01", "1 - Scale-up", "HHS/CDC", 5.0),
        (2025, "ALL", "HTS_TST", "N", "KeyPop/Result", "<01", "1 - Scale-up", "HHS/CDC", 100.0),
        (2025, "ALL", "HTS_INDEX", "N", "Age/Sex", "<01", "7 - Attained", "DOD", 2.0),
        (2025, "ALL", "TX_PVLS", "D", "Age/Sex", "<01", "7 - Attained", "DOD", 3.0),
        (2024, "ALL", "HTS_TST", "N", None, "<01", "7 - Attained", "DOD", 50.0),
    ]
    df = spark.createDataFrame(rows, TARGETS)
    by_place = targets.table_prioritization(df, 2025, ["1 - Scale-up", "7 - Attained"])
    assert [tuple(r) for r in by_place.collect()] == [
        (2025, "HTS_TST", None, 5.0, 0.0, 6), (2025, "HTS_INDEX", "Age/Sex", 0.0, 2.0, 9)]
    by_agency = targets.table_agency(df, 2025, ["CDC", "DOD"])
    assert [tuple(r) for r in by_agency.collect()] == [
        (2025, "TX_PVLS_D", None, 3.0, 3), (2025, "HTS_TST", 105.0, None, 6), (2025, "HTS_INDEX", None, 2.0, 9)]


def test_a_payload_is_written_per_country_not_per_request(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(6)], "c_custkey bigint, c_name string").write.parquet(
        str(tmp_path / "customer.parquet"))
    plan = tables.responses(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # what unfolds a country's requests stands above the text
    assert plan.count("array_join") == 1 and plan.index("Generate") < plan.index("array_join")
