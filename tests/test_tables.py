"""Tables are written when first read, from legs that are shuffled as narrow as they came."""

import glob
import os
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slipstream.operators.normalize import normalize
from slipstream.operators.reconcile import row_identity
from slipstream.operators.rollup import attribute_legs, build_slips, combined_slips
from slipstream.plans.catalog import QUERIES, Run
from slipstream.plans.tables import MONEY_COLUMNS, bound_tables, build_tables
from slipstream.session import scratch_table, shared_dir
from slipstream.sources import binding

KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Forty orders of five customers, two lines each."""
    path = tmp_path_factory.mktemp("small")
    made = {
        "customer": spark.range(5).select(F.col("id").alias("c_custkey"), F.col("id").cast("int").alias("c_nationkey")),
        "orders": spark.range(40).selectExpr(
            "id as o_orderkey", "id % 5 as o_custkey", "'F' as o_orderstatus", "cast(8000 + id as double) as o_totalprice"
        ),
        "lineitem": spark.range(80).selectExpr(
            "id div 2 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 2 as int) as l_linenumber",
            "2.0D as l_quantity", "1.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "'R' as l_returnflag",
            "'O' as l_linestatus", "timestamp '1996-01-01' as l_shipdate",
        ),
    }
    for name, df in made.items():
        df.write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_only_what_is_read_is_written(spark, small):
    made = bound_tables(spark, small)
    there = lambda: set(os.listdir(made.path.removeprefix("file:")))
    assert made.read("bound").count() == 80 and there() == {"bound"}
    assert made.slips.count() > 0 and there() == {"bound", "combined_slips", "all_slips"}
    assert made.legs.count() > 0 and there() == {"bound", "combined_slips", "all_slips", "matches", "legs"}


def test_lines_are_shuffled_once(spark, small):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = binding.bound_legs(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # customers and orders by customer, then orders and lines by order
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 4


def test_written_tables_equal_the_operators(spark, raw_legs):
    bets = [dict(uid=str(i % 3), bet_type="COMBINED" if i % 2 else "SIMPLE", match_id=i % 4 or None) for i in range(12)]
    legs = row_identity(raw_legs([*bets, {"bet_type": None}]))
    made = build_tables(spark, legs, scratch_table(spark, "own"))
    whole = normalize(legs)
    slips = build_slips(whole)
    rows = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    assert rows(made.all_slips, slips) == rows(slips, slips)
    shared = attribute_legs(whole, slips)
    assert rows(made.legs, shared) == rows(shared, shared)


def test_rows_derived_where_they_are_read_are_those_of_the_written_tables(spark, small):
    made = bound_tables(spark, small)
    rows = lambda df, columns: sorted(map(str, df.select(*columns).collect()))
    own = [c for c in made.slips.columns if c != "betslip_date"]
    assert rows(made.slip_rows, own) == rows(made.slips, own) != []
    columns = [c for c in made.legs.columns if c != "betslip_date"]
    alone = [c for c in columns if c not in ("fixture", "fixture_day")]
    assert rows(made.leg_rows(fixtures=True), columns) == rows(made.legs, columns) != []
    assert rows(made.plain_legs, alone) == rows(made.legs, alone)
    assert rows(made.money_legs, MONEY_COLUMNS) == rows(made.legs, MONEY_COLUMNS)
    assert rows(made.window_legs, made.window_legs.columns) == rows(made.legs, made.window_legs.columns)


DEALT_TO_DAYS = {"all_slips", "legs"}


@pytest.mark.parametrize(
    "name,writes",
    [
        ("fixture_groups", {"bound"}),
        ("headline_cards", {"bound", "combined_slips"}),
        ("group_by_slip_field", {"bound", "combined_slips"}),
        ("slips", {"bound"}),
        ("star_export_facts", {"bound", "combined_slips"}),
        ("star_export_decoded", {"bound", "combined_slips"}),
        ("fixture_flow", {"bound", "combined_slips", "matches"}),
        ("proxy_clv", {"bound", "combined_slips", "money_legs"}),
        ("sharpness_score", {"bound", "combined_slips", "money_legs"}),
        ("anomalies", {"bound", "combined_slips", "money_legs"}),
        ("filter_legs", {"bound", "combined_slips", "plain_legs"}),
    ],
)
def test_queries_of_all_rows_deal_none_to_days(spark, small, name, writes):
    other = Run(spark, small)
    QUERIES[name](other).count()
    assert set(os.listdir(other.tables.path.removeprefix("file:"))) == writes
    assert not writes & DEALT_TO_DAYS


def test_what_one_run_has_written_is_not_read_by_another(spark, small):
    """A query costs the same whatever ran before it."""
    first, second = Run(spark, small), Run(spark, small)
    assert first.tables.slips.count() == second.tables.slips.count()
    assert first.tables.path != second.tables.path
    assert first.tables is first.tables


def test_the_text_export_reads_bound_legs_once_and_writes_groups_of_them_alone(spark, small):
    before = {r["legs"] for r in QUERIES["load_export"](Run(spark, small)).collect()}
    other, scratch = Run(spark, small), shared_dir(spark).removeprefix("file:")
    own = f"{scratch}/{spark.sparkContext.applicationId}-*"  # other sessions may write there too
    tables_of = lambda: set(glob.glob(f"{own}/**/*.parquet", recursive=True))
    there = tables_of()
    assert {r["legs"] for r in QUERIES["load_export_text"](other).collect()} == before
    assert "tables" not in vars(other)
    rows = Counter()
    for file in tables_of() - there:
        rows[os.path.dirname(file)] += pq.ParquetFile(file).metadata.num_rows
    assert 0 < max(rows.values()) < 80


def test_written_slips_and_legs_are_dealt_to_days_narrow_and_simple_slips_not_at_all(spark, small, monkeypatch):
    run, path, dealt = Run(spark, small), scratch_table(spark, "written"), []
    kind, usual = type(spark.range(1)), type(spark.range(1)).hint

    def spy(df, name, *by):
        if by == ("betslip_date",):
            dealt.append(df)
        return usual(df, name, *by)

    monkeypatch.setattr(kind, "hint", spy)
    monkeypatch.setattr("slipstream.plans.catalog.scratch_table", lambda *_: path)
    assert QUERIES["write_slips_legs"](run).count() > 0
    legs, slips = sorted(dealt, key=lambda df: "n_legs" in df.columns and "event_ts" not in df.columns)
    assert not {"market_clean", "entity_player", "stake_eur", "stake_attr"} & set(legs.columns)
    assert {r["bet_type"] for r in slips.select("bet_type").collect()} == {"COMBINED"}
    rows = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    for name, like in (("slips", run.slip_rows), ("legs", run.tables.leg_rows(fixtures=True))):
        written = spark.read.parquet(f"{path}/{name}")
        assert rows(written, like) == rows(like, like) != []
        assert written.where("betslip_date <> to_date(betslip_ts)").count() == 0
    assert {r["bet_type"] for r in run.slip_rows.select("bet_type").collect()} == {"COMBINED", "SIMPLE"}


def test_combined_legs_are_shuffled_once_folded_by_slip(spark, small):
    plan = combined_slips(bound_tables(spark, small).normalized)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1
    assert "partial_count" in plan.split("Exchange hashpartitioning", 1)[1]
