"""Every operator as a named query over the bound tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from slipstream import schema
from slipstream.functions.numbers import money, rounded
from slipstream.operators import (
    anomalies, concentration, customers, facts, filters, findings, fixtures, prices, reconcile,
    rollup, series, star_export,
)
from slipstream.operators.filters import Filters
from slipstream.operators.normalize import normalize
from slipstream.plans.tables import Tables, bound_pulls, bound_tables
from slipstream.session import cut_lineage, scratch_table
from slipstream.sources import binding, tables as store
from slipstream.sources.exports import load_export, typed_legs

FIXTURE = ("Team1 - Side4", "2026-06-12")
SELECTION = ("Team1 - Side4", "Nth goal scorer", "Player 0")
SOME_LEGS = Filters(market_groups=["Goalscorer props"], competitions=["2026 FIFA World Cup"])
SOME_SLIPS = Filters(
    date_from="2026-06-05", date_to="2026-06-12", phases=["day-of pre-match", "in-play"],
    channels=["online", "retail"], currencies=["EUR", "PEN"],
)

# The fields that no other query sets.
ONE_FIELD = {
    "fixture": Filters(fixtures=[FIXTURE]),
    "team": Filters(teams=["Team3"]),
    "player": Filters(players=["Player 7"]),
    "match": Filters(match_ids=[60302, 61002]),
    "market": Filters(markets=["Anytime goalscorer [Star Sub]"]),
    "customer": Filters(uids=["36", "139"]),
    "unit": Filters(units=["UNIT PORTUGAL"]),
    "bet_type": Filters(bet_types=["COMBINED"]),
}


@dataclass(frozen=True)
class Run:
    """What the queries of one data folder read. Queries of one run share its tables, and only they: what
    another query has read before does not change what a query costs."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def tables(self) -> Tables:
        return bound_tables(self.spark, self.sf_dir)

    @property
    def slip_rows(self) -> DataFrame:
        return self.tables.slip_rows

    @property
    def window_legs(self) -> DataFrame:
        return self.tables.window_legs

    @property
    def plain_legs(self) -> DataFrame:
        return self.tables.plain_legs

    @property
    def money_legs(self) -> DataFrame:
        return self.tables.money_legs

    @property
    def bound(self) -> DataFrame:
        return self.tables.read("bound").drop("ok")

    @property
    def bound_once(self) -> DataFrame:
        """Bound legs for a query that reads them once: they are not written for it."""
        return binding.bound_legs(self.spark, self.sf_dir).drop("ok")

    @property
    def fresh(self) -> DataFrame:
        """Legs normalised in the query itself."""
        return normalize(reconcile.row_identity(self.bound))

    @property
    def normalized(self) -> DataFrame:
        return self.tables.normalized

    @property
    def all_slips(self) -> DataFrame:
        """Slips rolled up in the query itself, before the data window."""
        return rollup.build_slips(self.normalized)

    @property
    def slips(self) -> DataFrame:
        return self.tables.slips

    @property
    def legs(self) -> DataFrame:
        return self.tables.legs

    @property
    def pulls(self) -> tuple[DataFrame, DataFrame]:
        return bound_pulls(self.tables)

    @property
    def pairs(self) -> DataFrame:
        return reconcile.pair_pulls(*self.pulls)

    @property
    def priced(self) -> DataFrame:
        return prices.price_legs(self.money_legs)

    @property
    def stats(self) -> DataFrame:
        return prices.selection_stats(self.priced)

    @cached_property
    def stats_once(self) -> DataFrame:
        """Selection stats for queries that read them several times."""
        return cut_lineage(self.stats)

    @property
    def clv_legs(self) -> DataFrame:
        return prices.proxy_clv(self.priced, self.stats_once)

    @property
    def scored(self) -> DataFrame:
        return customers.scored_customers(self.slip_rows, self.money_legs, self.clv_legs)

    @property
    def watchlist(self) -> DataFrame:
        return customers.watchlist(self.scored)

    @property
    def anomalies(self) -> DataFrame:
        return anomalies.anomalies(self.slip_rows, self.money_legs, self.stats_once)

    @property
    def fixture_legs(self) -> DataFrame:
        return fixtures.with_fixture(self.legs)

    @property
    def fixture_table(self) -> DataFrame:
        return fixtures.fixture_table(self.fixture_legs, fixtures.groups_of(self.tables.matches))

    @property
    def one_fixture(self) -> DataFrame:
        return fixtures.fixture_slips(self.fixture_legs, *FIXTURE)

    @property
    def kickoff(self):
        name, day = FIXTURE
        groups = fixtures.groups_of(self.tables.matches)
        return groups.where((F.col("name") == name) & (F.col("day") == F.lit(day).cast("date"))).select(
            "kickoff"
        ).scalar()

    @cached_property
    def star(self) -> star_export.StarExport:
        return star_export.StarExport(self.slip_rows, self.tables.leg_rows(), self.window_legs)


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    """Simple column types: doubles rounded to ``places``, times and dates as text."""

    def flat(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType)):
            return rounded(c, places)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, T.IntegerType):
            return c.cast("long")
        return c

    return df.select(*[flat(f).alias(f.name) for f in df.schema.fields])


def _labels(run: Run, *columns: str) -> DataFrame:
    """How often each combination of input and output values occurs."""
    return run.fresh.groupBy(*columns).agg(F.count("*").alias("legs"))


def _as_export(legs: DataFrame) -> DataFrame:
    """Bound legs the way an export spells them: text, with the long headers."""
    spelled = {
        c: F.date_format(c, schema.EXPORT_TIME_FORMAT)
        if c in schema.TIME_COLUMNS
        else F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" "))
        for c in schema.LEG_COLUMNS
    }
    return legs.select(
        "source_row", *[spelled[new].alias(old) for old, new in schema.EXPORT_COLUMNS.items()]
    )


def _load_export(run: Run) -> DataFrame:
    path = scratch_table(run.spark, "export.parquet")
    _as_export(run.bound).write.parquet(path)
    return _export_groups(load_export(run.spark, path, "A"))


def _load_export_text(run: Run) -> DataFrame:
    """A delimited copy whose options hold line breaks, quotes and commas, read in about 50 blocks or more."""
    path = scratch_table(run.spark, "export")
    more = F.when(F.col("source_row") % 3 == 0, '\n"second" line, x').when(F.col("source_row") % 7 == 0, ' ""').otherwise("")
    spelled = _as_export(run.bound_once).withColumn("Option", F.concat(F.rtrim("Option"), more))
    keep = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    spelled.write.options(header=True, **keep).csv(path)
    # the files' lengths alone: their content is not read for it
    size = run.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    conf, name = run.spark.conf, "spark.sql.files.maxPartitionBytes"
    usual = conf.get(name)
    conf.set(name, str(min(max(size // 50, 1 << 14), 1 << 27)))
    shown = F.replace("option_raw", F.lit("\n"), F.lit("|"))
    texts = [
        F.sum(F.length("option_raw")).alias("option_chars"), F.max(shown).alias("last_option"),
        F.count_if(F.col("option_raw").contains("\n")).alias("broken_options"),
    ]
    try:
        return cut_lineage(_export_groups(load_export(run.spark, path, "A"), *texts))
    finally:
        conf.set(name, usual)


def _export_groups(loaded: DataFrame, *more: Column) -> DataFrame:
    return loaded.groupBy("source", "competition", "bet_type", "currency_raw").agg(
        F.count("*").alias("legs"),
        F.count("event_ts").alias("with_kickoff"),
        F.count_distinct("match_id").alias("match_ids"),
        F.sum(money(F.col("stake"))).alias("stake"),
        F.sum(money(F.col("ggr"))).alias("ggr"),
        F.min("betslip_ts").alias("first_bet"),
        F.max("source_row").alias("last_row"),
        *more,
    )


def _typed_legs(run: Run) -> DataFrame:
    renamed = _as_export(run.bound).withColumnsRenamed(schema.EXPORT_COLUMNS)
    return typed_legs(renamed, "A").drop("sport", "player_raw")


def _write_slips_legs(run: Run) -> DataFrame:
    path = scratch_table(run.spark, "written")
    run.tables.write_slips_legs(path)

    def days(name: str, stake: str) -> DataFrame:
        return store.read_by_day(run.spark, f"{path}/{name}").groupBy(F.lit(name).alias("name"), "betslip_date").agg(
            F.count("*").alias("rows"), F.sum(stake).alias("stake")
        )

    return days("slips", "stake_eur").unionByName(days("legs", "stake_attr"))


def _write_facts(run: Run) -> DataFrame:
    path = scratch_table(run.spark, "facts")
    cards, counts = facts.headline_cards(run.slip_rows), plain(facts.phase_counts(run.slip_rows), 2)
    store.write_facts({"cards": cards, "phases": counts}, path)
    back = store.read_fact(run.spark, path, "cards", cards)
    phases = store.read_fact(run.spark, path, "phases", counts)
    return back.unionByName(phases.select(F.col("phase").alias("label"), F.col("slips").cast("string").alias("value")))


def _listed(run: Run) -> DataFrame:
    flat = run.watchlist
    names = flat.schema["components"].dataType.fieldNames()
    return flat.select(
        *[c for c in flat.columns if c != "components"],
        *[F.col("components")[n].alias(f"component_{n}") for n in names],
    )


def _digest(run: Run) -> DataFrame:
    return customers.watchlist_digest(run.watchlist)


QUERIES: dict[str, Callable[[Run], DataFrame]] = {
    # sources, sinks, star export
    "load_export": _load_export,
    "load_export_text": _load_export_text,
    "typed_legs": _typed_legs,
    "write_slips_legs": _write_slips_legs,
    "write_facts": _write_facts,
    "star_export_dims": lambda r: r.star.dims,
    "star_export_facts": lambda r: r.star.slip_facts,
    "star_export_leg_facts": lambda r: r.star.leg_facts,
    "star_export_decoded": lambda r: star_export.decoded_legs(r.star.leg_facts, r.star.matches, r.star.markets).select(
        "row_id", "match_id", "name", "market_clean", "market_group"
    ),
    "matches_dim": lambda r: fixtures.matches_dim(r.window_legs),
    "markets_dim": lambda r: star_export.markets_dim(r.window_legs),
    "brand_name": lambda r: star_export.brand_name(r.slip_rows),
    # reconciliation
    "occurrence_key": lambda r: reconcile.occurrence_key(r.pulls[0].unionByName(r.pulls[1])).select(
        "source", "source_row", "occurrence"
    ),
    "file_stats": lambda r: reconcile.file_stats(r.pulls[0].unionByName(r.pulls[1])),
    "overlap_rows": lambda r: reconcile.overlap_rows(r.pairs).select(
        F.col("a_source_row").alias("source_row"), F.col("a_uid").alias("uid")
    ),
    "settlement_conflicts": lambda r: reconcile.settlement_conflicts(r.pairs),
    "later_wins": lambda r: reconcile.later_wins(r.pairs).select(
        "source_row", "uid", "stake", "ggr", "net_revenue"
    ),
    "reconciled_union": lambda r: reconcile.reconciled_union(r.pairs).select(
        "source", "source_row", "uid", "betslip_ts", "match_id", "option_raw", "stake", "ggr", "net_revenue"
    ),
    "row_identity": lambda r: reconcile.reconciled_union(r.pairs).select("source", "source_row", "row_id"),
    "exact_duplicates": lambda r: reconcile.exact_duplicates(r.window_legs),
    # normalisation
    "market_clean": lambda r: _labels(r, "market_raw", "market_clean"),
    "market_group": lambda r: _labels(r, "market_raw", "market_group"),
    "star_flag": lambda r: _labels(r, "market_raw", "star_substitute"),
    "match_sides": lambda r: _labels(r, "match", "team_home", "team_away"),
    "entity_team": lambda r: _labels(r, "market_raw", "match", "option_raw", "entity_team"),
    "entity_player": lambda r: _labels(r, "market_raw", "option_raw", "entity_player"),
    "extract_line": lambda r: _labels(r, "option_raw", "line"),
    "currency_infer": lambda r: _labels(r, "currency_raw", "unit", "currency", "currency_inferred"),
    "to_eur": lambda r: r.fresh.select("row_id", "currency", "stake_eur", "ggr_eur", "net_revenue_eur"),
    "channel": lambda r: _labels(r, "uid", "channel"),
    "unit_country": lambda r: _labels(r, "unit", "unit_country"),
    # rollup, phases, window
    "slip_id": lambda r: rollup.attribute_legs(r.normalized, r.all_slips).select("row_id", "slip_id"),
    "slips": lambda r: r.all_slips.drop("lead_minutes", "phase"),
    "leg_attribution": lambda r: rollup.attribute_legs(r.normalized, r.all_slips).select(
        "row_id", "n_legs", "stake_attr", "ggr_attr"
    ),
    "lead_minutes": lambda r: r.all_slips.select("slip_id", "lead_minutes"),
    "phase": lambda r: r.all_slips.select("slip_id", "phase"),
    "data_window": lambda r: rollup.window_report(r.all_slips),
    # facts
    "headline_totals": lambda r: facts.headline_totals(r.slip_rows),
    "raw_row_totals": lambda r: facts.raw_row_totals(r.window_legs),
    "phase_counts": lambda r: facts.phase_counts(r.slip_rows),
    "recon_table": lambda r: facts.recon_table(
        reconcile.file_stats(r.pulls[0].unionByName(r.pulls[1])), r.slip_rows, r.window_legs
    ),
    "consistency_check": lambda r: facts.consistency_check(
        r.slip_rows, r.window_legs, facts.headline_cards(r.slip_rows), r.star.slip_facts, r.star.leg_facts, strict=True
    ),
    # prices and customers
    "price_legs": lambda r: prices.price_legs(r.window_legs).select("row_id", "sel_key", "pre_ko"),
    "selection_stats": lambda r: r.stats,
    "selection_exposure": lambda r: prices.selection_exposure(r.stats),
    "eligible_selections": lambda r: prices.eligible_selections(r.stats).select("sel_key", "n_legs", "n_prices"),
    "proxy_clv": lambda r: r.clv_legs.select("row_id", "uid", "ref_price", "proxy_clv"),
    "customer_stats": lambda r: customers.customer_stats(r.slip_rows).select(
        "uid", "slips", "stake", "ggr", "avg_stake", "channel", "n_units", "customer_margin"
    ),
    "win_rate": lambda r: customers.win_rate(r.slip_rows),
    "phase_shares": lambda r: customers.phase_shares(r.slip_rows),
    "customer_clv": lambda r: customers.customer_clv(r.clv_legs),
    "eligible_customers": lambda r: customers.eligible_customers(customers.customer_stats(r.slip_rows)).select(
        "uid", "slips", "stake"
    ),
    "percentile_components": lambda r: r.scored.select("uid", "c_clv", "c_win", "c_lineup", "c_stake", "c_focus"),
    "market_focus_hhi": lambda r: customers.market_focus(r.money_legs).select("uid", "hhi"),
    "top_market_group": lambda r: customers.top_market_group(r.money_legs),
    "sharpness_score": lambda r: r.scored.select("uid", "score"),
    "watchlist": _listed,
    "watch_reasons": lambda r: customers.watch_reasons(r.watchlist),
    "risk_assumptions": lambda r: customers.risk_assumptions(r.scored, r.stats_once),
    # anomalies
    "price_drift": lambda r: anomalies.price_drift(r.stats),
    "repeated_support": lambda r: anomalies.repeated_support(r.stats_once),
    "exposure": lambda r: anomalies.exposure(r.stats),
    "negative_pocket": lambda r: anomalies.negative_pocket(r.money_legs),
    "turnover_spike": lambda r: anomalies.turnover_spike(r.slips, r.legs),
    "spike_driver": lambda r: anomalies.spike_driver(anomalies.spike_days(r.slips), r.legs),
    "anomalies": lambda r: anomalies.anomaly_counts(r.anomalies),
    # findings
    "phase_stats": lambda r: findings.phase_stats(r.slip_rows),
    "market_group_stats": lambda r: findings.market_group_stats(r.plain_legs),
    "channel_stats": lambda r: findings.channel_stats(r.slip_rows),
    "bet_type_stats": lambda r: findings.bet_type_stats(r.slip_rows),
    "channel_combined_mix": lambda r: findings.channel_combined_mix(r.slip_rows),
    "daily_flow": lambda r: findings.daily_flow(r.slip_rows),
    "worst_day_fixtures": lambda r: findings.worst_day_fixtures(r.slips, r.legs),
    "star_share": lambda r: findings.star_share(r.plain_legs),
    "core_product_share": lambda r: findings.core_product_share(r.plain_legs),
    "market_prefix_pocket": lambda r: findings.market_prefix_pocket(r.plain_legs),
    "top10_customer_share": lambda r: findings.top10_customer_share(r.slip_rows),
    "customer_gini": lambda r: findings.customer_gini(r.slip_rows),
    "watchlist_digest": _digest,
    "costliest_exposure": lambda r: findings.costliest_exposure(anomalies.exposure(r.stats)),
    "late_bets": lambda r: findings.late_bets(r.slip_rows),
    "fixture_merge_counts": lambda r: findings.fixture_merge_counts(r.window_legs),
    "billing_tiers": lambda r: findings.billing_tiers(r.slip_rows),
    "combined_composition": lambda r: findings.combined_composition(r.slip_rows),
    "repeated_selection_share": lambda r: findings.repeated_selection_share(r.plain_legs),
    "headline_cards": lambda r: facts.headline_cards(r.slip_rows),
    # interactive queries
    "filter_slips": lambda r: filters.filter_slips(r.slips, SOME_SLIPS).select("slip_id", "uid", "stake_eur"),
    "filter_by_legs": lambda r: filters.filter_by_legs(r.slips, r.legs, SOME_LEGS).select("slip_id", "stake_eur"),
    "filter_legs": lambda r: filters.filter_legs(r.plain_legs, SOME_LEGS).select("row_id", "slip_id"),
    **{
        f"filter_by_{name}": lambda r, f=f: filters.totals(filters.filter_by_legs(r.slips, r.legs, f))
        for name, f in ONE_FIELD.items()
    },
    "totals": lambda r: filters.totals(filters.filter_slips(r.slips, SOME_SLIPS)),
    "share_of_total": lambda r: filters.share_of_total(filters.filter_slips(r.slips, SOME_SLIPS), r.slips),
    "group_by_slip_field": lambda r: filters.group_by_slip_field(r.slip_rows, "unit"),
    "competition_breakdown": lambda r: filters.competition_breakdown(r.slip_rows),
    "time_series": lambda r: series.time_series(r.slip_rows, "turnover", "phase", series.DAY),
    "time_series_hourly": lambda r: series.time_series(r.slip_rows, "customers", "channel", series.HOUR),
    "time_series_avg": lambda r: series.time_series(r.slip_rows, "avg_stake", "bet_type", series.DAY),
    "time_series_ggr": lambda r: series.time_series(r.slip_rows, "ggr", "none", series.DAY),
    "time_series_slips": lambda r: series.time_series(r.slip_rows, "slips", "bet_type", series.HOUR),
    "series_totals": lambda r: series.series_totals(r.slip_rows, "customers", "channel", series.DAY),
    "fixture_groups": lambda r: fixtures.fixture_groups(r.window_legs),
    "fixture_slips": lambda r: r.one_fixture,
    "fixture_table": lambda r: r.fixture_table,
    "fixture_search": lambda r: fixtures.fixture_search(r.fixture_table, "side4"),
    "fixture_flow": lambda r: fixtures.fixture_flow(fixtures.fixture_slips(r.tables.leg_rows(fixtures=True), *FIXTURE), r.kickoff),
    "fixture_detail": lambda r: fixtures.fixture_detail(r.one_fixture),
    "concentrate_slip": lambda r: concentration.concentrate_slip(r.slip_rows, "uid"),
    "concentrate_leg": lambda r: concentration.concentrate_leg(r.plain_legs, "selection"),
    **{
        f"concentrate_slip_{dim}": lambda r, dim=dim: concentration.concentrate_slip(r.slip_rows, dim)
        for dim in concentration.SLIP_DIMS[1:]
    },
    **{
        f"concentrate_leg_{dim}": lambda r, dim=dim: concentration.concentrate_leg(r.plain_legs, dim)
        for dim in ("competition", "market_group", "market", "player")
    },
    "concentrate_line": lambda r: concentration.concentrate_leg(r.plain_legs, "line"),
    "concentrate_team": lambda r: concentration.concentrate_leg(r.plain_legs, "team"),
    "top_n_share": lambda r: concentration.top_n_share(concentration.concentrate_leg(r.plain_legs, "player")),
    "top_n_share_selection": lambda r: concentration.top_n_share(
        concentration.concentrate_leg(r.plain_legs, "selection")
    ),
    "top10_share": lambda r: concentration.top10_share(concentration.concentrate_slip(r.slip_rows, "uid")),
    "lorenz": lambda r: concentration.lorenz(concentration.concentrate_slip(r.slip_rows, "uid")),
    "gini": lambda r: concentration.gini(concentration.concentrate_leg(r.plain_legs, "selection"), "Selection"),
    "drill_rows": lambda r: concentration.drill_rows(r.plain_legs, "market_group", "Team stats"),
    "drill_total": lambda r: concentration.drill_total(r.plain_legs, "market_group", "Team stats"),
    "price_trace": lambda r: prices.price_trace(r.plain_legs, *SELECTION),
}


def run_query(name: str, spark: SparkSession, sf_dir: str, run: Run | None = None) -> DataFrame:
    """A registered query, over tables of its own or those of ``run``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return plain(QUERIES[name](run or Run(spark, sf_dir)))
