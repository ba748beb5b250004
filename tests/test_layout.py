"""How written days are clustered, and what a filter on one customer or fixture reads of them."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slipstream.sources import tables

ROWS = 60_000


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    """One day in one file: 100 customers and 30 fixtures in no order."""
    path = str(tmp_path_factory.mktemp("day") / "legs")
    mixed = F.xxhash64("id")
    rows = spark.range(ROWS).select(
        "id", F.concat(F.lit("u"), F.pmod(mixed, F.lit(100))).alias("uid"),
        F.concat(F.lit("f"), F.pmod(F.xxhash64(mixed), F.lit(30))).alias("fixture"),
        F.lit("2026-06-15 12:00:00").cast("timestamp").alias("betslip_ts"),
    )
    tables.write_by_day(rows.coalesce(1), path)
    return path


def rows_read(df) -> int:
    """Rows that the scan hands on, by the plan's own metric."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    todo = [node]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_one_fixture_reads_a_tenth_of_the_day(spark, day):
    legs = spark.read.parquet(day)
    got = legs.where("fixture = 'f7'")
    assert got.count() == ROWS / 30 or abs(got.count() - ROWS / 30) < 300
    assert rows_read(got.select("id", "uid")) <= ROWS / 10


def test_one_customer_of_one_fixture_reads_a_page_or_two(spark, day):
    legs = spark.read.parquet(day).where("fixture = 'f7' and uid = 'u3'")
    assert rows_read(legs.select("id")) <= 2 * tables.PAGE_ROWS


def test_one_customer_of_a_table_without_fixtures_reads_a_tenth(spark, tmp_path):
    rows = spark.range(ROWS).select(
        "id", F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(100))).alias("uid"),
        F.lit("2026-06-15 12:00:00").cast("timestamp").alias("betslip_ts"),
    )
    tables.write_by_day(rows.coalesce(1), str(tmp_path / "slips"))
    slips = spark.read.parquet(str(tmp_path / "slips")).where("uid = 'u42'")
    assert rows_read(slips.select("id")) <= ROWS / 10


def test_row_groups_carry_bloom_filters(spark, day):
    unknown = spark.read.parquet(day).where("uid = 'u3x'")  # within the range of the statistics
    assert rows_read(unknown) == 0
    (file,) = glob.glob(f"{day}/*/*.parquet")
    assert pq.ParquetFile(file).metadata.num_rows == ROWS
