import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slipstream import schema
from slipstream.sources.exports import load_export
from slipstream.sources.records import read_lines, records

HEAD = ["Billing report", "", "pulled today", ""]


def write(path, names, rows):
    path.write_text("\n".join([*HEAD, ",".join(names), *rows]) + "\n", encoding="utf-8")
    return str(path)


NAMES = ["", *schema.EXPORT_COLUMNS, "Extra"]
GOOD = (
    '0, Football ,Test Cup,100,"Alpha - Beta, A",15/06/2026 18:00:00,Match,SIMPLE,,Opt,'
    "15/06/2026 12:00:00, 12345,UNIT NORTH,3.5,10,1.5,0.8,EUR,x"
)
BAD = "1,Football,Test Cup,abc,Alpha - Beta,31/31/2026 18:00:00,Match,SIMPLE,,Opt,nonsense,1,U,x,,n/a,0.8,,x"


def test_reads_below_the_header_and_types(spark, tmp_path):
    legs = load_export(spark, write(tmp_path / "a.csv", NAMES, [GOOD, BAD]), "B")
    assert legs.columns == [*schema.LEG_COLUMNS, "source", "source_row"]
    good, bad = legs.orderBy("source_row").collect()
    assert (good["sport"], good["match"], good["uid"], good["source"]) == ("Football", "Alpha - Beta, A", "12345", "B")
    assert good["betslip_ts"] == datetime(2026, 6, 15, 12) and good["match_id"] == 100 and good["ggr"] == 1.5
    assert (bad["match_id"], bad["event_ts"], bad["betslip_ts"], bad["price"], bad["stake"]) == (None,) * 5


def test_missing_column_is_an_error(spark, tmp_path):
    names = [n for n in NAMES if n != "GGR"]
    with pytest.raises(ValueError, match="GGR"):
        load_export(spark, write(tmp_path / "a.csv", names, [GOOD]), "A")


def test_a_line_without_row_number_is_an_error(spark, tmp_path):
    path = write(tmp_path / "a.csv", NAMES, [GOOD, "x" + GOOD[1:]])
    with pytest.raises(Exception, match="without a row number"):
        load_export(spark, path, "A").collect()


def test_quotes_inside_quotes_exact_ids_and_odd_blanks(spark, tmp_path):
    rows = [
        '0,Football,Test Cup,9007199254740993,"Alpha ""X"" - Beta",15/06/2026 18:00:00,Match,SIMPLE,,Opt,'
        "15/06/2026 12:00:00,12345,UNIT NORTH\u00a0,3.5,10d,1e1,.5,EUR,x",
        GOOD.replace("0,", "1,", 1).replace(",100,", ",100.5,"),
        GOOD.replace("0,", "2,", 1).replace(",100,", ",100.0,"),
    ]
    a, b, c = load_export(spark, write(tmp_path / "a.csv", NAMES, rows), "A").orderBy("source_row").collect()
    assert (a["match_id"], a["match"], a["unit"]) == (9007199254740993, 'Alpha "X" - Beta', "UNIT NORTH")
    assert (a["stake"], a["ggr"], a["net_revenue"]) == (None, 10.0, 0.5)
    assert (b["match_id"], c["match_id"]) == (None, 100)


def test_truncated_and_overlong_lines_are_errors(spark, tmp_path):
    for line in ("4,Football,Test", GOOD + ",more,and more"):
        path = write(tmp_path / f"{len(line)}.csv", NAMES, [GOOD, line])
        with pytest.raises(Exception, match="other fields than the header"):
            load_export(spark, path, "A").collect()


def test_only_lines_above_the_header_are_dropped(spark, tmp_path):
    """A data line may repeat a line of the preamble or of another file."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [GOOD.replace("0,", f"{10 * k},", 1), GOOD.replace("0,", f"{10 * k + 1},", 1)]
        top = [rows[1]] * k + HEAD if k else HEAD
        text = "\n".join([*top, ",".join(NAMES), *rows]) + "\n"
        (tmp_path / "in" / f"{k}.csv").write_text(text, encoding="utf-8")
    got = load_export(spark, str(tmp_path / "in"), "A")
    assert sorted(r["source_row"] for r in got.collect()) == [0, 1, 10, 11, 20, 21]


def test_files_with_different_headers_are_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", NAMES, [GOOD])
    write(tmp_path / "in" / "b.csv", [*NAMES[:-1], "Other"], [GOOD])
    with pytest.raises(ValueError, match="different headers"):
        load_export(spark, str(tmp_path / "in"), "A")


def test_parquet_keeps_long_ids(spark, tmp_path):
    loaded = load_export(spark, write(tmp_path / "a.csv", NAMES, [GOOD]), "A").drop("source")
    back = {new: old for old, new in schema.EXPORT_COLUMNS.items()}
    wide = loaded.withColumnsRenamed(back)
    wide = wide.withColumn("MatchId", wide["MatchId"] + 9007199254740893)
    for c in ("Event date (utc)", "Betslip date (utc)"):
        wide = wide.withColumn(c, F.date_format(F.col(f"`{c}`"), schema.EXPORT_TIME_FORMAT))
    wide.write.parquet(str(tmp_path / "x.parquet"))
    assert load_export(spark, str(tmp_path / "x.parquet"), "A").first()["match_id"] == 9007199254740993


def test_a_file_without_a_header_is_an_error(spark, tmp_path):
    """Part files after the first may lack the header; their rows must not vanish."""
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", NAMES, [GOOD])
    (tmp_path / "in" / "b.csv").write_text("\n \n", encoding="utf-8")
    assert load_export(spark, str(tmp_path / "in"), "A").count() == 1
    (tmp_path / "in" / "c.csv").write_text(GOOD.replace("0,", "1,", 1) + "\n", encoding="utf-8")
    for action in ("collect", "count"):
        with pytest.raises(Exception, match="file without a header line"):
            getattr(load_export(spark, str(tmp_path / "in"), "A"), action)()


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 64 bytes, far shorter than a record."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def multi_line(n: int, option: str) -> str:
    quoted = option.replace('"', '""')
    return GOOD.replace("0,", f"{n},", 1).replace(",Opt,", f',"{quoted}",')


OPTIONS = ["plain", "two\nlines", 'a "quoted" word', '"\n"\n,', "blank\n\n\nlines", "long " * 40 + "\n" + "tail " * 40, "x\r\ny", '""', "end"]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_line_breaks_inside_quotes_over_many_blocks(spark, tmp_path, small_blocks, line_end):
    (tmp_path / "in").mkdir()
    expected = {}
    for k in range(2):
        rows = [multi_line(100 * k + i, o) for i, o in enumerate(OPTIONS * 3)]
        expected |= {100 * k + i: o.strip() for i, o in enumerate(OPTIONS * 3)}
        top = ["Billing 'report", 'a 5" screen', ""]  # quotes above the header say nothing
        text = line_end.join([*top, ",".join(NAMES), *rows, "", ""])
        (tmp_path / "in" / f"{k}.csv").write_bytes(text.encode())
    got = {r["source_row"]: r["option_raw"] for r in load_export(spark, str(tmp_path / "in"), "A").collect()}
    assert got == expected


def test_a_header_far_below_and_one_record_of_many_blocks(spark, tmp_path):
    rows = [multi_line(1, "\n".join(f"line {i}" for i in range(500))), GOOD]
    path = write(tmp_path / "a.csv", NAMES, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = {r["source_row"]: r["option_raw"] for r in load_export(spark, path, "A").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == "Opt" and got[1].count("\n") == 499


def test_quotes_that_do_not_close_are_an_error(spark, tmp_path):
    path = write(tmp_path / "a.csv", NAMES, [GOOD, GOOD.replace(",Opt,", ',"Opt,'), GOOD])
    with pytest.raises(Exception, match="quotes do not close"):
        load_export(spark, path, "A").collect()


def test_lines_without_breaks_are_not_shuffled(spark, tmp_path):
    """Blocks with one record a line go straight to the parser."""
    plan = load_export(spark, write(tmp_path / "a.csv", NAMES, [GOOD] * 9), "A")._jdf.queryExecution().executedPlan().toString()
    first_branch = plan.split("Union", 1)[1].split("Window", 1)[0]
    assert "Exchange hashpartitioning" not in first_branch


def test_lines_of_a_block_are_shuffled_once_and_crossing_records_alone(spark, tmp_path, small_blocks):
    path = tmp_path / "one.csv"
    path.write_text("".join(f'{i},"a\nb""c",x\n' for i in range(40)) + '40,"' + "\n" * 200 + '"\n41,""\n')
    lines = read_lines(spark, str(path))
    found = records(lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(file#\d+, block#\d+L", plan)) == 1
    got = sorted(r["value"] for r in found.collect())
    assert got == sorted([*(f'{i},"a\nb""c",x' for i in range(40)), '40,"' + "\n" * 200 + '"', '41,""'])


def test_records_of_a_block_are_put_together_by_the_task_that_reads_it(spark, tmp_path):
    """Only lines of records that cross blocks are shuffled, even where nothing is small enough to be broadcast unasked."""
    path = write(tmp_path / "a.csv", NAMES, [multi_line(i, o) for i, o in enumerate(OPTIONS * 3)])
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loaded = load_export(spark, path, "A")
        plan = loaded._jdf.queryExecution().executedPlan().toString()
        got = {r["source_row"]: r["option_raw"] for r in loaded.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got == {i: o.strip() for i, o in enumerate(OPTIONS * 3)}
    assert "Exchange hashpartitioning" not in plan.split("MapInArrow", 1)[1].split("Window", 1)[0]


def test_records_that_cross_arrow_batches_and_bytes_that_are_not_utf8(spark, tmp_path):
    lines = [b'1,"a\nb""c",x', b'2,"' + b"\n" * 9 + b'\xff\xc3",y', b"3,z\xe9,", b'4,"\r\n",']
    (tmp_path / "a.csv").write_bytes(b"\n".join(lines * 5) + b"\n")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = records(read_lines(spark, str(tmp_path / "a.csv"))).select(F.hex("value").alias("h")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert sorted(bytes.fromhex(r["h"]) for r in found) == sorted(lines * 5)
