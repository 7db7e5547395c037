import os
import re

import pytest
from pyspark.sql import functions as F

from quarterline.operators.aggregate import read_metadata, snapshot_metadata
from quarterline.schemas import INDICATOR_RESULTS, TARGETS
from quarterline.sources.harvest import (
    failed_requests, harvest, label_estimates, parse_payloads, read_payloads, rejected_lines, request_grid, request_url,
    with_operating_unit,
)
from quarterline.sources.snapshots import (
    latest_snapshot, list_snapshots, newest_results, profile, read_indicators, read_targets, write_by, write_csv, year_folders,
)

ROW = (2023, "I", "Total Numerator", "Index", "A", "1", "one", 1.0, None, 0.0, 2.0, None, 3.0)


def _touch(folder, name, when):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("x")
    os.utime(path, (when, when))


def test_latest_snapshot(spark, tmp_path):
    folder = str(tmp_path)
    _touch(folder, "RESULTS_FY22-24_north.txt", 1_000_000)
    _touch(folder, "RESULTS_FY22-24_south.txt", 2_000_000)
    _touch(folder, "other.txt", 9_000_000)
    assert latest_snapshot(spark, folder, "RESULTS.*").endswith("/RESULTS_FY22-24_south.txt")
    assert latest_snapshot(spark, folder, "north").endswith("/RESULTS_FY22-24_north.txt")
    _touch(folder, "RESULTS_FY22-24_tie.txt", 2_000_000)
    assert latest_snapshot(spark, folder, "RESULTS.*").endswith("_tie.txt")
    _touch(folder, "RESULTS_FY22-24_parts/part-0", 1_000_000)
    _touch(folder, "RESULTS_FY22-24_parts/part-1", 3_000_000)
    assert latest_snapshot(spark, folder + "/", "RESULTS.*").endswith("/RESULTS_FY22-24_parts")
    assert list_snapshots(spark, folder, "RESULTS").count() == 4
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, folder, "absent")


def test_latest_snapshot_in_a_folder_named_like_its_parent(spark, tmp_path):
    folder = str(tmp_path / "data" / "data")
    _touch(folder, "a.txt", 1_000_000)
    assert latest_snapshot(spark, folder, "a").endswith("/data/data/a.txt")


@pytest.mark.parametrize("form", ["tsv", "csv", "parquet"])
def test_read_indicators(spark, tmp_path, rows, form):
    df = spark.createDataFrame([ROW], INDICATOR_RESULTS)
    path = str(tmp_path / form)
    if form == "parquet":
        df.write.parquet(path)
    else:
        df.write.csv(path, sep="\t" if form == "tsv" else ",", header=True, nullValue="NA")
    got = read_indicators(spark, path, form)
    assert got.schema == INDICATOR_RESULTS and rows(got) == [ROW]


def _years(spark, *rows):
    return spark.createDataFrame([(year, *ROW[1:7], *quarters, 5.0, None) for year, *quarters in rows], INDICATOR_RESULTS)


def test_metadata_reads_the_newest_year_with_results_only(spark, tmp_path):
    df = _years(spark, (2022, 1.0, 1.0, 1.0, 1.0), (2023, 1.0, 0.0, None, None), (2023, 1.0, None, None, None), (2024, None, None, None, None))
    path = str(tmp_path / "s")
    write_by(df, path, "fiscal_year")
    assert year_folders(spark, path) == [2024, 2023, 2022]
    newest = newest_results(spark, path)
    assert re.search(r"PartitionFilters: \[[^]]*fiscal_year#\d+ = 2023", newest._jdf.queryExecution().executedPlan().toString())
    row = snapshot_metadata(newest, "s").first()
    assert (row["curr_fy"], row["curr_qtr"], row["curr_pd"]) == (2023, 2, "FY23Q2")
    # folders of other years are not opened: they need not even be readable
    for part in (tmp_path / "s" / "fiscal_year=2022").glob("*.parquet"):
        part.write_bytes(b"not a table")
    assert read_metadata(newest_results(spark, path), "s").curr_key == 2023 * 4 + 2


def test_metadata_of_plain_files(spark, tmp_path):
    path = str(tmp_path / "s")
    _years(spark, (2022, 1.0, 1.0, 1.0, 1.0), (2023, 1.0, None, None, None), (2024, None, None, None, None)).write.parquet(path)
    assert year_folders(spark, path) == []
    assert read_metadata(newest_results(spark, path), "s").curr_pd == "FY23Q1"
    empty = str(tmp_path / "e")
    _years(spark, (2024, None, None, None, None)).write.parquet(empty)
    assert newest_results(spark, empty).count() == 0


def test_read_targets_by_type(spark, tmp_path):
    data = [(2023, k, "I", "N", None, "<01", "p", "A", 1.0) for k in ("SUBNAT", "ALL", "ALL")]
    spark.createDataFrame(data, TARGETS).write.parquet(str(tmp_path / "t"))
    assert read_targets(spark, str(tmp_path / "t"), "ALL").count() == 2
    assert read_targets(spark, str(tmp_path / "t"), "SUBNAT").count() == 1


def test_write_csv_tells_null_from_empty(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "i INT, s STRING").coalesce(1)
    write_csv(df, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert text.splitlines() == ["i,s", "1,NA", '2,""', "3,x"]
    back = spark.read.schema("i INT, s STRING").csv(
        str(tmp_path / "o"), header=True, nullValue="NA", emptyValue="")
    assert rows(back) == [(1, None), (2, ""), (3, "x")]


def test_write_by_makes_one_folder_per_value(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("mech_code"), "id").repartition(8)
    write_by(df, str(tmp_path / "m"), "mech_code")
    folders = sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_dir())
    assert folders == ["mech_code=0", "mech_code=1", "mech_code=2"]
    assert all(len(list((tmp_path / "m" / f).glob("*.parquet"))) == 1 for f in folders)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1000


def test_profile(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "i INT, s STRING")
    assert rows(profile(df)) == [("i", "int", 3, 3, 3), ("s", "string", 3, 2, 1)]


def test_request_grid_and_url(spark):
    countries = spark.createDataFrame([("A B", "a b")], "country STRING, iso STRING")
    grid = request_grid(countries)
    assert grid.count() == 27
    first = grid.filter("batch_no = 4").select(request_url("http://x/d?").alias("u")).first()["u"]
    assert first == (
        "http://x/d?country=a+b&indicator=unaware_plhiv_num&ageGroup=Y020_024&period=2022-4"
        "&sex=female&areaLevel=2")


HEADER = "area,level,mean,lower,upper"
CARRY = ["request_id", "age", "period"]


def _responses(spark, *payloads):
    return spark.createDataFrame(
        [(str(i), "Y015_999", "2022-4", p) for i, p in enumerate(payloads, 1)],
        "request_id STRING, age STRING, period STRING, payload STRING")


def test_parse_payloads(spark, rows):
    df = _responses(
        spark, HEADER + '\r\nLand,0,1.5,x,2\r\n"North, upper",2,NA,,3\r\n', HEADER, HEADER + "\n\nOnly,2,1,1,1\n")
    got = rows(parse_payloads(df, ["request_id"]))
    assert got == [("1", 1, "Land", 0.0, 1.5, None, 2.0), ("1", 2, "North, upper", 2.0, None, None, 3.0),
                   ("3", 1, "Only", 2.0, 1.0, 1.0, 1.0)]


PROBLEMS = {
    '{"error": "indicator not recognised"}': "missing columns", "": "empty payload", None: "no payload",
    'area,level,mean,lower,upper\n"a,1,2,3,4': "a quote is not closed",
    "area,level,mean,lower,upper\na,1,2": "a line with another number of fields",
    "area,level,mean,lower,upper,level\na,1,2,3,4,5": "a column twice",
}


def test_failed_requests_are_reported_and_not_fatal(spark):
    good = "area,level,mean,lower,upper\na,1,2,3,4"
    df = _responses(spark, *PROBLEMS, good)
    assert [r["request_id"] for r in parse_payloads(df, ["request_id"]).collect()] == [str(len(PROBLEMS) + 1)]
    found = [r["problem"] for r in failed_requests(df, ["request_id"]).orderBy("request_id").collect()]
    assert all(problem.startswith(start) for problem, start in zip(found, PROBLEMS.values()))
    assert len(found) == len(PROBLEMS)
    with pytest.raises(Exception, match="payload: "):
        parse_payloads(df, ["request_id"], on_problem="fail").collect()


def test_a_bad_line_costs_only_itself(spark, rows):
    df = _responses(spark, HEADER + "\na,0,1,2,3\nb,2,1\nc,2,1,2,3,4\nd,2,7,8,9\nLate,0,1", HEADER + "\ne,2,1,1,1")
    assert rows(parse_payloads(df, ["request_id"]), "request_id", "line_no", "area") == [
        ("1", 1, "a"), ("1", 4, "d"), ("2", 1, "e")]
    assert [tuple(r) for r in rejected_lines(df, ["request_id"]).orderBy("line_no").collect()] == [
        ("1", 2, ["b", "2", "1"], "3 fields instead of 5"), ("1", 3, ["c", "2", "1", "2", "3", "4"], "6 fields instead of 5"),
        ("1", 5, ["Late", "0", "1"], "3 fields instead of 5")]
    assert [r["problem"] for r in failed_requests(df, ["request_id"]).collect()] == ["a line with another number of fields"]
    # a rejected line names no unit
    named = harvest(df.withColumns({c: F.lit("x") for c in ("iso", "indicator", "sex")}))
    assert {r["operatingunit"] for r in named.filter("request_id = '1'").collect()} == {"a"}
    with pytest.raises(Exception, match="another number of fields"):
        parse_payloads(df, ["request_id"], on_problem="fail").collect()


@pytest.mark.parametrize("sign", ["\x1d", "\x1e", "\x1f", "\x1d0\x1e1\x1f2"])
def test_control_characters_belong_to_their_field(spark, sign):
    payload = f'{HEADER}\r\np{sign}q,0,1,2,3\r\n"r{sign},\ns""{sign}",2,1,2,3\r\n'
    got = parse_payloads(_responses(spark, payload), ["request_id"]).orderBy("line_no").collect()
    assert [r["area"] for r in got] == [f"p{sign}q", f'r{sign},\ns"{sign}']


def test_further_columns_are_kept_in_a_map(spark):
    payload = "area,Source,level,mean,lower,upper,note\na,s1,0,1,2,3,\nb,s2,2,1,2,3,late"
    got = parse_payloads(_responses(spark, payload), ["request_id"], others="others").orderBy("line_no").collect()
    assert [r["others"] for r in got] == [{"source": "s1", "note": ""}, {"source": "s2", "note": "late"}]


def test_a_payload_is_cut_once(spark):
    parsed = parse_payloads(_responses(spark, HEADER).withColumn("payload", F.concat("payload", F.lit("\na,0,1,2,3"))), ["request_id"])
    plan = parsed.filter("level = 0 AND upper > mean")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(transform(filter(CASE WHEN NOT Contains(_text") == 1
    assert plan.count("Contains(_text") == 1
    # what makes the payload is not written again for each reader either
    assert plan.count("concat(payload") == 1


def test_columns_by_name_and_quoted_breaks(spark):
    payload = 'unit,Upper,area,"level",mean,lower\r\nx,9,"Two\nlines, ""one"" more",0,1,2\r\ny,8,plain,2,bad,3\r\n'
    got = parse_payloads(_responses(spark, payload), ["request_id"]).orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in got] == [
        ('Two\nlines, "one" more', 0.0, 1.0, 2.0, 9.0), ("plain", 2.0, None, 3.0, 8.0)]


def test_fill_inside_the_payload_needs_no_shuffle(spark):
    plan = harvest(_responses(spark, "area,level,mean,lower,upper\na,0,2,3,4").withColumns(
        {c: F.lit("x") for c in ("iso", "indicator", "sex")}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_operating_unit_by_request_and_run_on(spark):
    df = _responses(
        spark, HEADER + "\nLand,0,1,1,1\nNorth,2,1,1,1", HEADER + "\nSouth,2,1,1,1\nEast,2,1,1,1")
    by_request = harvest(df, CARRY).orderBy("request_id", "line_no").collect()
    assert [r["operatingunit"] for r in by_request] == ["Land", "Land", None, None]
    assert {(r["age"], r["period"]) for r in by_request} == {("15+", "Dec 2022")}
    lines = parse_payloads(df, ["request_id"]).withColumn("request_no", F.col("request_id").cast("int"))
    run_on = with_operating_unit(lines, ["request_no", "line_no"], group=(), few=())
    assert [r["operatingunit"] for r in run_on.orderBy("request_no", "line_no").collect()] == ["Land"] * 4
    assert harvest(df, CARRY, levels=[0]).count() == 1


def test_label_estimates_keeps_unknown_codes(spark, rows):
    df = spark.createDataFrame([("adults", "2023-1")], "age STRING, period STRING")
    assert rows(label_estimates(df)) == [("adults", "2023-1")]


def test_payloads_read_once_serve_all_three_results(spark, rows):
    """Accepted lines, rejected lines and failed requests come from one reading of the payloads."""
    payloads = [
        (1, 'area,level,mean,lower,upper\n"A, ""x""\nb",0,1,2,3\nshort,2'), (2, None), (3, 'area,"level'), (4, ""),
        (5, "area,level,mean,lower,upper\r\nB\x1d,2,1,2,x"), (6, 'area,level,mean,lower,upper\n "C" ,"",1,2,\n""D,2,\x1f,"1",2'),
    ]
    responses = spark.createDataFrame(payloads, "request_id bigint, payload string")
    read = read_payloads(responses, ["request_id"])
    for operator in (parse_payloads, rejected_lines, failed_requests):
        assert rows(operator(read, ["request_id"])) == rows(operator(responses, ["request_id"]))
    assert rows(parse_payloads(read, ["request_id"]), "request_id", "line_no", "area", "mean", "upper") == [
        (1, 1, 'A, "x"\nb', 1.0, 3.0), (5, 1, "B\x1d", 1.0, None), (6, 1, "C", 1.0, None), (6, 2, '"D', None, 2.0)]
    assert "Parquet" in read._jdf.queryExecution().toString() and "array_join" not in read._jdf.queryExecution().toString()
