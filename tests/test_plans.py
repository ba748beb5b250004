"""What no plan may hold; test_oracles.py checks every registered query."""

import re

import pytest

from slipstream.operators import filters
from slipstream.operators.filters import Filters
from slipstream.plans.catalog import QUERIES, Run

SF_DIR = "/root/testdata/sf0.001"
# A join without an equality would compare all rows with all rows; Python nodes
# would leave the JVM.
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow", "BatchEvalPython"]

# Queries whose windows have no partition, and why their input is bounded.
BOUNDED_ORDER = {
    "turnover_spike": "days",
    "spike_driver": "days",
    "anomalies": "days",
    "watchlist_digest": "60 customers",
    "top_n_share": "at most 100 rows",
    "top_n_share_selection": "at most 100 rows",
    # totals of the range partitions of an ordered table
    "star_export_facts": "range partitions",
    "star_export_leg_facts": "range partitions",
    "consistency_check": "range partitions",
    "customer_gini": "range partitions",
    "gini": "range partitions",
    "lorenz": "range partitions",
}


def check_plan(name: str, df) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]
    bare = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line) and _unpartitioned(line)]
    assert not bare or name in BOUNDED_ORDER


def _unpartitioned(line: str) -> bool:
    """A window specification that starts with an order has no partition."""
    spec = re.search(r"windowspecdefinition\((.*)", line)
    first = spec.group(1).split(",")[0]
    return " ASC " in first or " DESC " in first


@pytest.mark.parametrize("table,column", [("legs", "stake_attr"), ("slips", "stake_eur")])
def test_day_filter_prunes_and_columns_are_cut(spark, table, column):
    df = Run(spark, SF_DIR).tables.read(table)
    plan = df.where("betslip_date = date'2026-06-10'").groupBy("channel").agg({column: "sum"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(betslip_date" in text
    assert re.search(rf"ReadSchema: struct<(channel:string,{column}:decimal\(18,6\)|{column}:decimal\(18,6\),channel:string)>", text)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["filter_slips", "worst_day_fixtures", "spike_driver"])
def test_registered_queries_prune_days(spark, name):
    text = plan_text(QUERIES[name](Run(spark, SF_DIR)))
    assert re.search(r"PartitionFilters: \[[^\]]*betslip_date", text)


def test_leg_filters_prune_days(spark):
    run, f = Run(spark, SF_DIR), Filters(date_from="2026-06-10", date_to="2026-06-10", players=["Player 7"])
    for df in (filters.filter_by_legs(run.slips, run.legs, f), filters.filter_legs(run.legs, f)):
        scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_text(df))
        assert scans and all("betslip_date" in s and ">=" in s for s in scans if s)
        assert any("betslip_date" in s for s in scans)


def test_one_fixture_is_a_plain_filter(spark):
    assert "Join" not in plan_text(QUERIES["fixture_slips"](Run(spark, SF_DIR)))


def test_combined_legs_are_folded_by_hash_first(spark):
    text = plan_text(QUERIES["slips"](Run(spark, SF_DIR)))
    assert "Expand" not in text
    assert re.search(r"HashAggregate\(keys=\[uid[^\n]*partial_product", text)


def test_lookups_neither_sort_a_table_nor_roll_up_twice(spark):
    text = plan_text(QUERIES["leg_attribution"](Run(spark, SF_DIR)))
    assert "TakeOrderedAndProject" not in text and "product(" not in text


def test_fixture_table_reads_legs_once_and_has_no_distinct(spark):
    text = plan_text(QUERIES["fixture_table"](Run(spark, SF_DIR)))
    assert len(re.findall(r"FileScan parquet [^\n]*tables/legs", text)) == 1
    assert "betslip_ts" not in text  # no wide rows of a slip are made distinct
