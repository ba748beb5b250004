"""The whole batch: two raw exports in, tables, facts and a star export out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipstream.operators import (
    anomalies, cubes, customers, facts, findings, prices, reconcile, rollup, star_export,
)
from slipstream.plans.tables import Tables, build_tables
from slipstream.session import cut_lineage
from slipstream.sources import tables as store
from slipstream.sources.exports import load_export


@dataclass(frozen=True)
class Batch:
    tables: Tables
    watchlist: DataFrame
    anomalies: DataFrame
    consistency: DataFrame


def additive_facts(slips: DataFrame, legs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Every document that counts and sums slips or legs, the headline, and the raw row totals.

    Slips are read once and legs twice, the second time for copies of a leg only; all else comes from the
    written cubes.
    """
    of_slips, of_legs = cubes.slip_cube(slips), cubes.leg_cube(legs)
    flow, uids = of_slips.part("flow"), of_slips.part("customers")
    markets = of_legs.part("markets")
    headline = cut_lineage(facts.headline_of_cube(flow, uids))
    raw = facts.raw_row_totals(markets)
    documents = {
        "headline": headline,
        "raw_rows": raw,
        "phases": findings.phase_stats(flow),
        "market_groups": findings.market_group_stats(markets),
        "channels": findings.channel_stats(flow),
        "exact_duplicates": reconcile.exact_duplicates(legs, of_legs.part("copies")),
        "cards": facts.cards_of(headline),
        "bet_types": findings.bet_type_stats(flow),
        "channel_combined_mix": findings.channel_combined_mix(flow),
        "daily_flow": findings.daily_flow(flow),
        "worst_day_fixtures": findings.worst_day_fixtures(flow, of_legs.part("days")),
        "star_share": findings.star_share(markets),
        "core_product_share": findings.core_product_share(markets),
        "market_prefix_pocket": findings.market_prefix_pocket(markets),
        "top10_customer_share": findings.top10_customer_share(uids),
        "customer_gini": findings.customer_gini(uids),
        "late_bets": findings.late_bets(flow),
        "fixture_merge_counts": findings.fixture_merge_counts(
            of_legs.part("fixtures").withColumnRenamed("match_name", "match")
        ),
        "billing_tiers": findings.billing_tiers(of_slips.part("rates")),
        "combined_composition": findings.combined_composition(flow),
        "repeated_selection_share": findings.repeated_slips(of_legs.part("same_game").where("slip_id is not null")),
    }
    return documents, headline, raw


def run_batch(spark: SparkSession, first_export: str, later_export: str, out: str) -> Batch:
    """Run everything and write it under ``out``. Stops if surfaces disagree."""
    a = cut_lineage(load_export(spark, first_export, "A"))
    b = cut_lineage(load_export(spark, later_export, "B"))
    pairs = cut_lineage(reconcile.pair_pulls(a, b))
    made = build_tables(spark, reconcile.reconciled_union(pairs), f"{out}/tables")
    slips, legs = made.slips, made.legs

    priced = prices.price_legs(legs)
    stats = cut_lineage(prices.selection_stats(priced))
    scored = cut_lineage(customers.scored_customers(slips, legs, prices.proxy_clv(priced, stats)))
    watch = customers.watchlist(scored)
    flags = cut_lineage(anomalies.anomalies(slips, legs, stats))

    star, made_star = f"{out}/star", star_export.StarExport(slips, legs)
    store.write_table(made_star.dims, f"{star}/dims", ["dim"])
    for name in ("matches", "markets"):
        store.write_table(getattr(made_star, name), f"{star}/{name}")
    store.write_table(made_star.slip_facts, f"{star}/slips")
    store.write_table(made_star.leg_facts, f"{star}/legs")

    stats_of_files = reconcile.file_stats(a.unionByName(b))
    documents, headline, raw = additive_facts(slips, legs)
    cards = documents["cards"]
    store.write_facts(
        {
            "files": stats_of_files,
            "settlement_conflicts": reconcile.settlement_conflicts(pairs),
            **documents,
            "window": rollup.window_report(made.all_slips),
            "recon_table": facts.recon_lines(stats_of_files, headline, raw),
            "assumptions": customers.risk_assumptions(scored, stats),
            "watchlist": watch,
            "anomalies": flags,
            "overlap": reconcile.overlap_rows(pairs).agg(F.count("*").alias("rows")),
            "union": made.normalized.agg(F.count("*").alias("rows")),
            "watchlist_digest": customers.watchlist_digest(watch),
            "watch_reasons": customers.watch_reasons(watch),
            "costliest_exposure": findings.costliest_exposure(anomalies.exposure(stats)),
        },
        f"{out}/facts",
    )
    check = facts.compare_surfaces(
        headline,
        raw,
        store.read_fact(spark, f"{out}/facts", "cards", cards),
        spark.read.parquet(f"{star}/slips"),
        spark.read.parquet(f"{star}/legs"),
        strict=True,
    )
    check = cut_lineage(check)
    return Batch(made, watch, flags, check)
