import re

import pytest
from test_exports import NAMES, write

from slipstream.operators import facts, findings, reconcile
from slipstream.plans.batch import additive_facts, run_batch
from slipstream.plans.catalog import Run

SF_DIR = "/root/testdata/sf0.001"

LINE = (
    "{i},Football,Test Cup,100,Alpha - Beta,15/06/2026 18:00:00,Match corners,{kind},,Over 2.5,"
    "15/06/2026 12:00:0{s},{uid},UNIT NORTH,3.5,{stake},{ggr},0.8,EUR,x"
)


def lines(*bets):
    keys = ("kind", "s", "uid", "stake", "ggr")
    return [LINE.format(i=i, **dict(zip(keys, b))) for i, b in enumerate(bets)]


def test_two_exports_to_consistent_surfaces(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    a = write(
        tmp_path / "a" / "first.csv",
        NAMES,
        lines(("SIMPLE", 0, "1", 10, 10), ("COMBINED", 1, "2", 20, 20), ("COMBINED", 1, "2", 20, 20)),
    )
    b = write(
        tmp_path / "b" / "later.csv",
        NAMES,
        lines(("SIMPLE", 0, "1", 10, -25), ("SIMPLE", 2, "MAH-3", 5, 5)),
    )
    done = run_batch(spark, a, b, str(tmp_path / "out"))
    got = {r["metric"]: (r["recon"], r["ok"]) for r in done.consistency.collect()}
    assert all(ok for _, ok in got.values())
    assert got["turnover"][0] == "€35" and got["ggr"][0] == "€0"
    assert got["slips"][0] == "3" and got["legs"][0] == "4" and got["customers"][0] == "3"
    files = spark.read.json(str(tmp_path / "out" / "facts" / "files"))
    assert {(r["source"], r["rows"]) for r in files.collect()} == {("A", 3), ("B", 2)}


SINGLE = {
    "headline": lambda s, l: facts.headline_totals(s),
    "raw_rows": lambda s, l: facts.raw_row_totals(l),
    "phases": lambda s, l: findings.phase_stats(s),
    "market_groups": lambda s, l: findings.market_group_stats(l),
    "channels": lambda s, l: findings.channel_stats(s),
    "exact_duplicates": lambda s, l: reconcile.exact_duplicates(l),
    "cards": lambda s, l: facts.headline_cards(s),
    "bet_types": lambda s, l: findings.bet_type_stats(s),
    "channel_combined_mix": lambda s, l: findings.channel_combined_mix(s),
    "daily_flow": lambda s, l: findings.daily_flow(s),
    "worst_day_fixtures": findings.worst_day_fixtures,
    "star_share": lambda s, l: findings.star_share(l),
    "core_product_share": lambda s, l: findings.core_product_share(l),
    "market_prefix_pocket": lambda s, l: findings.market_prefix_pocket(l),
    "top10_customer_share": lambda s, l: findings.top10_customer_share(s),
    "customer_gini": lambda s, l: findings.customer_gini(s),
    "late_bets": lambda s, l: findings.late_bets(s),
    "fixture_merge_counts": lambda s, l: findings.fixture_merge_counts(l),
    "billing_tiers": lambda s, l: findings.billing_tiers(s),
    "combined_composition": lambda s, l: findings.combined_composition(s),
    "repeated_selection_share": lambda s, l: findings.repeated_selection_share(l),
}


def values(df) -> list:
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_documents_of_the_cubes_equal_those_of_the_tables(spark, empty):
    run = Run(spark, SF_DIR)
    slips, legs = run.slips, run.legs
    if empty:
        slips, legs = slips.where("false"), legs.where("false")
    documents, _, _ = additive_facts(slips, legs)
    assert set(documents) == set(SINGLE)
    for name, df in documents.items():
        alone = SINGLE[name](slips, legs)
        assert df.columns == alone.columns, name
        plain = [re.sub(r"Decimal\('0E-6'\)", "Decimal('0.000000')", v) for v in values(df)]
        assert plain == [re.sub(r"Decimal\('0E-6'\)", "Decimal('0.000000')", v) for v in values(alone)], name


def test_all_documents_read_no_slips_and_legs_once_beside_the_cubes(spark):
    """The two cubes read each table once; of what follows, only copies of a leg go back to the legs."""
    run = Run(spark, SF_DIR)
    documents, headline, raw = additive_facts(run.slips, run.legs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*documents.values(), headline, raw]]
    scans = lambda table: sum(len(re.findall(rf"FileScan parquet [^\n]*tables/{table}", p)) for p in plans)
    assert (scans("legs"), scans("all_slips")) == (1, 0)


def test_two_legs_of_one_forced_fingerprint_are_no_copies(spark, norm, monkeypatch):
    from pyspark.sql import functions as F

    legs = norm([dict(uid="1"), dict(uid="2"), dict(uid="3"), dict(uid="3"), dict(uid="3", price=2.0)])
    real = reconcile.exact_duplicates(legs).first()
    monkeypatch.setattr(reconcile, "fingerprints", lambda: [F.lit(7), F.lit(7)])
    forced = reconcile.exact_duplicates(legs).first()
    assert real == forced and real["dup_rows"] == 2


def test_the_window_leaves_days_out_of_one_written_table(spark, tmp_path):
    run = Run(spark, SF_DIR)
    assert run.tables.all_slips.count() > run.slips.count()
    text = run.slips._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*betslip_date[^\]]*>= ", text)
